"""Reshaping: trajectories to transcripts and training rows, nested and long forms, prompts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trajlake.functions.core import as_map, last_wins, let, present
from trajlake.functions.text import action_params, file_extension, strip


def message(role: str, content: Column) -> Column:
    return F.struct(F.lit(role).alias("role"), content.alias("content"))


def to_messages(steps: Column, statement: Column, working_dir: Column, system: str, functions: str, prompt: str) -> Column:
    """array<role, content>: system, function notes, the prompt with its placeholders filled, then for each step the
    assistant's thought and action and the tool's observation."""
    filled = F.replace(F.replace(F.lit(prompt), F.lit("{problem_statement}"), F.coalesce(statement, F.lit(""))), F.lit("{working_dir}"), F.coalesce(working_dir, F.lit("")))
    turns = F.flatten(F.transform(steps, lambda s: F.array(message("assistant", F.concat(F.coalesce(s["thought"], F.lit("")), F.lit("\n\n"), F.coalesce(s["action"], F.lit("")))), message("tool", F.coalesce(s["observation"], F.lit(""))))))
    return F.concat(F.array(message("system", F.lit(system)), message("system", F.lit(functions)), message("user", filled)), turns)


def trajectories_to_sft(df: DataFrame, system: str, functions: str, prompt: str) -> DataFrame:
    """Trajectories (trajectory_steps, problem_statement, working_dir, reward) as rows of transcripts with the last step's counters."""
    last = F.get("trajectory_steps", F.size("trajectory_steps") - 1)
    return df.select(to_messages(F.col("trajectory_steps"), F.col("problem_statement"), F.col("working_dir"), system, functions, prompt).alias("input"), last["token_usage_total"].alias("token_usage_total"), last["step_count"].alias("step_count"), "reward")


def nested_messages(df: DataFrame, conv: str, turn: str, role: str, text: str) -> DataFrame:
    """(conv, messages, n_turns): a row for each conversation, messages in the order of turns."""
    g = df.groupBy(conv).agg(F.array_sort(F.collect_list(F.struct(turn, F.col(role).alias("role"), F.col(text).alias("content")))).alias("_m"))
    return g.select(conv, F.transform("_m", lambda m: F.struct(m["role"].alias("role"), m["content"].alias("content"))).alias("messages"), F.size("_m").alias("n_turns"))


def long_messages(df: DataFrame, conv: str, messages: str) -> DataFrame:
    return df.select(conv, F.posexplode(messages).alias("turn", "_m")).select(conv, "turn", "_m.role", "_m.content")


def parsed_json(text: Column) -> Column:
    """variant of JSON text; text that is JSON in a JSON string is parsed again; null if it isn't JSON."""
    once = F.try_parse_json(text)
    inner = F.try_parse_json(F.try_variant_get(once, "$", "string"))
    return F.coalesce(inner, once)


def json_columns(df: DataFrame, columns: list[str], strict: bool = False) -> DataFrame:
    """columns as JSON values beside flags <c>_converted. strict: a value that isn't JSON is an error."""
    for c in columns:
        v = parsed_json(F.col(c))
        ok = v.isNotNull()
        df = df.withColumn(f"{c}_converted", ok).withColumn(c, F.when(ok | F.col(c).isNull(), F.to_json(v)).otherwise(F.raise_error(F.concat(F.lit(f"{c} is not JSON: "), F.substring(c, 1, 80))) if strict else F.col(c)))
    return df


def local_dir(df: DataFrame, root: str, existing: DataFrame) -> DataFrame:
    """df with path root/<repo with __ for />, where that path exists. The repository is repo, or repo_name if that's empty."""
    path = F.concat(F.lit(root.rstrip("/") + "/"), F.replace(present(F.col("repo"), F.col("repo_name")), F.lit("/"), F.lit("__")))
    return df.withColumn("path", path).join(existing.select("path"), "path", "left_semi")


def trace_samples(df: DataFrame, traces: str) -> DataFrame:
    """A row for each trace struct<stdout, stderr, exit_code, type>: real_output with both streams under their marks."""
    t = F.col("_t")
    text = F.concat(F.lit("[STDOUT]\n\n"), F.coalesce(t["stdout"], F.lit("")), F.lit("\n\n[STDERR]\n\n"), F.coalesce(t["stderr"], F.lit("")))
    out = df.select(*[c for c in df.columns if c != traces], F.explode(traces).alias("_t"))
    return out.withColumns({"real_output": text, "real_error_code": F.coalesce(t["exit_code"], F.lit(-1)), "type": F.coalesce(t["type"], F.lit("step_execution"))}).drop("_t")


def rl_row(prompt: Column, truth: Column, style: str, extra: Column) -> Column:
    """struct<prompt, reward_model, extra_info>."""
    return F.struct(F.array(message("user", prompt)).alias("prompt"), F.struct(F.lit(style).alias("style"), truth.alias("ground_truth")).alias("reward_model"), extra.alias("extra_info"))


def wrapped(df: DataFrame, instruction: str, question: str = "problem", answer: str = "answer", style: str = "rule") -> DataFrame:
    """Problems as training rows; extra_info is the whole row as JSON."""
    return df.select(rl_row(F.concat(F.col(question), F.lit(" " + instruction)), F.col(answer).cast("string"), style, F.to_json(F.struct(*df.columns))).alias("r")).select("r.*")


def tests_with_metadata(tests: Column, metadata: Column) -> Column:
    """JSON text of the tests, each with the metadata; every test needs a func_name in it."""
    return F.when(metadata["func_name"].isNull(), F.raise_error(F.lit("metadata has no func_name"))).otherwise(F.to_json(F.transform(tests, lambda t: t.withField("metadata", metadata))))


def hotpot_row(df: DataFrame, source: str = "hotpotqa", head: int | None = None) -> DataFrame:
    out = df.select("question", F.col("answer").alias("ground_truth"), F.lit(source).alias("data_source"))
    return out.limit(head) if head else out


def synthetic_grid(spark, n: int, seed: int, sizes: tuple[int, int] = (2, 10), p: tuple[float, float] = (0.6, 0.85)) -> DataFrame:
    """n rows (index, seed, size, p) from a seeded generator."""
    return spark.range(n).select(F.col("id").alias("index"), F.floor(F.rand(seed) * 100_000).cast("int").alias("seed"), (F.lit(sizes[0]) + F.floor(F.rand(seed + 1) * (sizes[1] - sizes[0]))).cast("int").alias("size"), (F.lit(p[0]) + F.rand(seed + 2) * (p[1] - p[0])).alias("p"))


def repeated(df: DataFrame, n: Column | int) -> DataFrame:
    """Each row n times side by side, with copy from 0; a count of 0 drops it."""
    n = F.lit(n) if isinstance(n, int) else n
    return df.filter(n > 0).withColumn("copy", F.explode(F.sequence(F.lit(0), n - 1)))


def zipped_map(names: Column, codes: Column) -> Column:
    """struct<m, mismatch>: a map of two arrays as far as the shorter one reaches; the last of repeated names counts."""
    n = F.least(F.size(names), F.size(codes))
    pairs = F.slice(F.arrays_zip(names.alias("k"), codes.alias("v")), 1, F.greatest(n, F.lit(0)))
    placed = F.transform(pairs, lambda p, i: F.struct(p["k"].alias("k"), i.alias("i"), p["v"].alias("v")))
    return F.struct(as_map(last_wins(placed)).alias("m"), (F.size(names) != F.size(codes)).alias("mismatch"))


def merged_tests(public: Column, private: Column) -> Column:
    """Both lists joined; null if that's one test or none."""
    none = F.array().cast("array<struct<input:string,output:string>>")
    return let(F.concat(F.coalesce(public, none), F.coalesce(private, none)), lambda t: F.when(F.size(t) > 1, t))


# Difficulty numbers of the problem collections' names.
DIFFICULTY = {
    "taco": {"EASY": 1.9, "MEDIUM": 3.7, "MEDIUM_HARD": 5.5, "HARD": 7.3, "VERY_HARD": 9.1},
    "apps": {"introductory": 2.5, "interview": 5.5, "competition": 8.5},
}


def level_number(level: Column) -> Column:
    """The number that ends a level's name, else 0."""
    return F.coalesce(F.element_at(F.split(F.trim(level), r"\s+"), -1).try_cast("double"), F.lit(0.0))


def recoded(column: Column, table: dict[str, float], default: float = -1.0) -> Column:
    out = None
    for k, v in table.items():
        out = (F.when if out is None else out.when)(column == k, v)
    return out.otherwise(default)


def starter_code(test: Column) -> Column:
    """Stub functions for the names that a test imports from the solution."""
    names = F.regexp_extract_all(test, F.lit(r"(?m)^from\s+solution\s+import\s+(.+)$"), F.lit(1))
    each = F.filter(F.transform(F.flatten(F.transform(names, lambda x: F.split(x, ","))), strip), lambda x: x != "")
    return F.array_join(F.transform(F.array_distinct(each), lambda x: F.concat(F.lit("def "), x, F.lit("(*args, **kwargs):\n    pass"))), "\n\n")


def prompt_sections(sections: list[tuple[str, Column]], missing: str = "(not available)") -> Column:
    """Titled sections, with a placeholder for what is null or blank."""
    return F.concat_ws("\n\n", *[F.concat(F.lit(f"## {title}\n"), F.coalesce(F.nullif(strip(c), F.lit("")), F.lit(missing))) for title, c in sections])


def verifier_sample(transcript: Column, patch: Column, reward: Column) -> Column:
    """struct<prompt, response, label>: is the patch right? YES for reward 1."""
    label = F.when(reward == 1, "YES").otherwise("NO")
    return F.struct(F.concat(F.lit("Here is a run of an agent.\n\n"), transcript, F.lit("\n\nIts patch:\n"), F.coalesce(patch, F.lit("")), F.lit("\n\nDoes the patch solve the issue? Answer YES or NO.")).alias("prompt"), F.concat(F.lit("<judgement>"), label, F.lit("</judgement>")).alias("response"), label.alias("label"))


def last_step_sft(df: DataFrame, steps: str, reward: str, threshold: float) -> DataFrame:
    """Messages of the last step of trajectories with reward of at least the threshold, contents trimmed; at least two messages."""
    m = F.transform(F.get(F.col(steps), F.size(steps) - 1)["chat_completions"], lambda x: F.struct(x["role"].alias("role"), strip(x["content"]).alias("content")))
    return df.filter(F.col(reward) >= threshold).select(m.alias("messages")).filter(F.size("messages") >= 2)


def trajectory_facts(steps: Column) -> Column:
    """struct of what a trajectory's steps add up to."""
    total = lambda c: F.aggregate(steps, F.lit(0).cast("double"), lambda s, x: s + F.coalesce(x[c].cast("double"), F.lit(0.0)))
    return F.struct(
        F.size(steps).alias("n_steps"), total("token_usage_prompt").alias("prompt_tokens"), total("token_usage_completion").alias("completion_tokens"), total("token_usage_total").alias("total_tokens"),
        total("llm_exec_time").alias("llm_time"), total("env_exec_time").alias("env_time"), F.array_max(F.transform(steps, lambda x: x["llm_exec_time"])).alias("max_llm_time"),
        F.size(F.filter(steps, lambda x: F.contains(x["action"], F.lit("<function=submit>")))).alias("submits"), F.get(steps, F.size(steps) - 1)["done"].alias("done"))


def step_files(steps: Column, functions: tuple[str, ...], command: str | None = None, root: str = "") -> Column:
    """array<string>: the path of each step's action whose function is one of these (and whose command is this one), in order,
    if its last part has a dot. root is cut from the paths. Paths come as often as steps name them."""
    called = F.transform(steps, lambda s: action_params(s["action"]))
    hit = F.filter(called, lambda a: a["fn"].isin(*functions) & ((a["params"]["command"] == command) if command else F.lit(True)) & F.contains(F.substring_index(a["params"]["path"], "/", -1), F.lit(".")))
    return F.transform(hit, lambda a: F.replace(a["params"]["path"], F.lit(root), F.lit("")) if root else a["params"]["path"])


def created_files(steps: Column, root: str = "/testbed/") -> Column:
    return step_files(steps, ("file_editor",), "create", root)


def edited_files(steps: Column, root: str = "/testbed/") -> Column:
    return step_files(steps, ("file_editor",), "str_replace", root)


def viewed_files(steps: Column) -> Column:
    return step_files(steps, ("file_viewer",))


def extensions(paths: Column) -> Column:
    """The different extensions of paths, sorted, without their dots."""
    return F.sort_array(F.array_distinct(F.transform(paths, lambda p: F.substring(file_extension(p), 2, 1000))))


def trajectory_metrics(df: DataFrame, steps: str, image: str, reward: str, patch: str, true_patch: str, edited_lines: str, p2p: str, regression: str) -> DataFrame:
    """One row of derived fields for each trajectory.

    patch is the true patch, or if that is missing the agent's; its size goes by the same rule. Without a count of edited
    lines there are 100 of them, without a list of P2P tests one. regression: a map of test to status.
    """
    s, text = F.col(steps), F.coalesce(true_patch, patch)
    rows = df.select(
        F.col(image).alias("docker_image"), F.col(reward).alias("pass_at_1"), F.size(s).alias("step_count"), F.col(true_patch).alias("patch"), F.length(text).alias("patch_size"),
        F.coalesce(edited_lines, F.lit(100)).alias("patch_num_lines"), created_files(s).alias("created_files"), edited_files(s).alias("edited_files"), viewed_files(s).alias("viewer_files"),
        F.coalesce(F.size(p2p), F.lit(1)).alias("p2p_rate"), F.size(F.filter(F.map_values(regression), lambda v: v == "PASSED")).alias("regression_pass_count"), trajectory_facts(s).alias("_f"))
    rows = rows.withColumn("num_created_files", F.size("created_files")).withColumn("edited_extensions", extensions(F.col("edited_files"))).withColumn("viewer_extensions", extensions(F.col("viewer_files")))
    return rows.select(*[c for c in rows.columns if c != "_f"], "_f.*")


def trace_text(steps: Column) -> Column:
    """A readable trace."""
    return F.array_join(F.transform(steps, lambda s, i: F.concat_ws("\n", F.concat(F.lit("=== step "), (i + 1).cast("string"), F.lit(" ===")), F.concat(F.lit("thought: "), F.coalesce(s["thought"], F.lit(""))), F.concat(F.lit("action: "), F.coalesce(s["action"], F.lit(""))), F.concat(F.lit("observation: "), F.coalesce(s["observation"], F.lit(""))))), "\n\n")


def ordered_case(column: Column, rules: list[tuple[str, str]], default: str) -> Column:
    """The value of the first rule whose text the column holds."""
    out = None
    for needle, value in rules:
        out = (F.when if out is None else out.when)(F.contains(column, F.lit(needle)), value)
    return out.otherwise(default)


def task_type(source: Column, metadata: Column, by_source: dict[str, list[str]], by_key: dict[str, list[str]]) -> Column:
    """Task type by data source, then by the keys that a metadata map has, else unknown."""
    out = None
    for kind, names in by_source.items():
        out = (F.when if out is None else out.when)(source.isin(*names), kind)
    for kind, keys in by_key.items():
        out = out.when(F.exists(F.map_keys(metadata), lambda k: k.isin(*keys)), kind)
    return out.otherwise("unknown")


# Words of image names that tell the family of an instance, and the family's folder.
IMAGE_FAMILIES = [("xingyaoww", "swe_gym"), ("swebench", "swe_bench_verified"), ("epoch-research", "swe_bench_verified"), ("swerebench", "swe_rebench")]


def spec_path(root: str, image: Column, instance: Column) -> Column:
    """Cache path of an instance's test specification: <root>/<family of its image>/<instance>.json."""
    return F.concat(F.lit(root.rstrip("/") + "/"), ordered_case(image, IMAGE_FAMILIES, "others"), F.lit("/"), instance, F.lit(".json"))


def task_row(df: DataFrame, source: str, system: str, user: str, statement: str = "problem_statement") -> DataFrame:
    """Rows of agent tasks: a system and a user message, whose {problem_statement} is filled, an empty truth, and the row as JSON."""
    filled = F.replace(F.lit(user), F.lit("{problem_statement}"), F.coalesce(F.col(statement), F.lit("")))
    return df.select(
        F.lit(source).alias("data_source"), F.array(message("system", F.lit(system)), message("user", filled)).alias("prompt"), F.lit(source).alias("ability"),
        F.struct(F.lit("rule").alias("style"), F.lit("").alias("ground_truth")).alias("reward_model"), F.to_json(F.struct(*df.columns)).alias("extra_info"))


def repeated_batches(df: DataFrame, order: list[str], n: int, interleave: bool = True) -> DataFrame:
    """A batch of rows n times, with at, the place in the new batch: each row's copies side by side if interleaved, else the
    whole batch again and again."""
    from trajlake.operators.order import global_index

    ranked = global_index(df, order, "_at").withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    if interleave:
        return ranked.withColumn("at", F.col("_at") * n + F.col("copy")).drop("_at")
    size = df.agg(F.count("*").alias("_all"))
    return ranked.crossJoin(F.broadcast(size)).withColumn("at", F.col("copy") * F.col("_all") + F.col("_at")).drop("_at", "_all")


def io_tests(inputs: Column, outputs: Column) -> Column:
    """array<input, output> of two lists; the shorter one goes on with its first element."""
    n = F.greatest(F.size(inputs), F.size(outputs))
    pick = lambda a, i: F.coalesce(F.get(a, i), F.get(a, F.lit(0)), F.lit(""))
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.struct(pick(inputs, i).alias("input"), pick(outputs, i).alias("output")))).otherwise(F.array().cast("array<struct<input:string,output:string>>"))


def submission(df: DataFrame, instance: str, patch: str, model: str) -> DataFrame:
    return df.select(F.col(instance).alias("instance_id"), F.lit(model).alias("model_name_or_path"), F.coalesce(F.col(patch), F.lit("")).alias("model_patch"))
