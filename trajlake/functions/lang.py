"""Languages of repositories and commands, and which commands run tests."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that tell a repository's language, in the order in which they are tried.
REPO_WORDS = {
    "javascript": ["express", "lodash", "moment", "axios", "chalk", "mocha", "react", "vue", "jquery", "koa", "hapi", "fastify", "socket.io", "socket-io", "nodemon", "browserify"],
    "typescript": ["typescript", "eslint", "prettier", "webpack", "jest", "angular", "nestjs", "typeorm", "ts-node", "inversify", "rxjs", "typestack"],
    "rust": ["rust", "cargo", "tokio", "serde", "actix", "hyper", "rustfmt", "clippy", "rocket", "diesel", "reqwest"],
    "go": ["golang", "gin", "gorm", "cobra", "gorilla", "hugo", "kubernetes", "docker", "etcd", "prometheus"],
    "java": ["spring", "maven", "gradle", "junit", "hibernate", "mockito", "jackson", "guava", "netty"],
}
# Patterns of commands that run tests, by language, in the order in which they are tried.
COMMANDS = {
    "python": r"\b(python\d*|pytest)\b",
    "javascript": r"\b(jest|mocha|jasmine|vitest|npm\s+(?:run\s+)?test|yarn\s+(?:run\s+)?test|npx\s+(?:jest|mocha|vitest))\b",
    "typescript": r"\b(jest|ts-jest|mocha|vitest|npm\s+(?:run\s+)?test|yarn\s+(?:run\s+)?test|npx\s+(?:jest|ts-jest|mocha|vitest))\b",
    "rust": r"\bcargo\s+(?:test|bench|nextest\s+run)\b",
    "go": r"\bgo\s+test\b",
    "java": r"\b(?:mvn|./mvnw)\s+(?:test|verify|surefire:test)|(?:gradle|./gradlew)\s+(?:test|check)|\bjunit\b",
}
# Install commands, which are not simulated.
INSTALLS = {
    "python": ["pip install", "pip3 install", "conda install"],
    "javascript": ["npm install", "npm ci", "yarn install", "yarn add", "pnpm install"],
    "typescript": ["npm install", "npm ci", "yarn install", "yarn add", "pnpm install"],
    "rust": ["cargo add", "cargo install"],
    "go": ["go get", "go mod download", "go install"],
    "java": ["mvn install", "gradle dependencies"],
}


def detect_language(repo: Column, command: Column) -> Column:
    """By the repository's name, then by the command, else python."""
    out = F.when(F.lit(False), "")
    for lang, words in REPO_WORDS.items():
        out = out.when(F.exists(F.array(*[F.lit(w) for w in words]), lambda w: F.contains(F.lower(repo), w)), lang)
    for lang, pattern in COMMANDS.items():
        out = out.when(F.trim(command).rlike(pattern), lang)
    return out.otherwise("python")


def is_test_command(code: Column, lang: str = "python") -> Column:
    """A call of execute_bash that runs something of the language, is no git command and installs nothing."""
    s = F.regexp_replace(F.coalesce(code, F.lit("")), r"^\s+|\s+$", "")
    skip = F.exists(F.array(*[F.lit(p) for p in INSTALLS[lang]]), lambda p: F.contains(F.lower(s), p))
    runs = s.rlike(COMMANDS[lang])
    if lang == "python":
        runs = runs | F.contains(s, F.lit("python ")) | F.contains(s, F.lit("python3 "))
    return s.startswith("execute_bash") & ~F.contains(s, F.lit("git ")) & ~skip & runs
