"""Collocations by hierarchical pair naming.

A frequent word gets a number. A phrase of k words is the pair of the numbers of its first and its last k - 1 words, and if the
pair is frequent, it gets a number too. So each level replaces neighbouring numbers by the number of their pair, names stay two
longs however long the phrase is, and the two halves of a name are pointers to the phrases it is made of: cuts
are looked up along them, and a phrase's longer neighbours are the names that point to it.

Documents are kept in blocks, in a table bucketed by block, so that texts never cross the network. At each level a block asks
buckets of hashes, with the counts of its distinct pairs; a bucket adds up, numbers the frequent ones in their order, and answers
which of the pairs are frequent and their numbers. Pairs meet by their full value, so counts are exact; a frequent word or
pair is one entry of each block, however often it occurs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trajlake.llm.common import from_planes, planes, small_batches, spread_join, squeezed, table, unsqueezed, written
from trajlake.llm.suffix_dedup import _block_table, _by_bucket, _give_back, _grouped, spans

END = b"\xff"  # the end of a piece; no byte of UTF-8
JOIN = b"\xfe"
LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ\t,;:!?\x0b\x0c\r.", b"abcdefghijklmnopqrstuvwxyz " + b"\n" * 9)
ASK = "bucket int, block long, n int, data binary"
TOLD = "kind int, block long, bucket int, data binary, id long, left long, right long, lang string, word string, f long"
ANSWER, NAME, TOTAL = 0, 1, 2


class Coded:
    """The words of a block's documents as numbers, language by language, with -1 between pieces. All follows from the block alone.

    keys: the language, END and the word of each number.
    """

    def __init__(self, langs: list[str], lens: list[int], data: bytes):
        ends = np.cumsum(lens).tolist()
        by_lang: dict[str, list[bytes]] = {}
        for lang, n, e in zip(langs, lens, ends):
            by_lang.setdefault(lang, []).append(data[e - n : e])
        self.keys, codes = [], []
        for lang in sorted(by_lang):
            words = b"\n".join(by_lang[lang]).translate(LOWER).replace(b"\n", b" " + END + b" ").split()
            distinct = dict.fromkeys(words)
            distinct.pop(END, None)
            number = dict(zip(distinct, range(len(self.keys), len(self.keys) + len(distinct)))) | {END: -1}
            codes += [np.fromiter(map(number.__getitem__, words), np.int64, len(words)), np.full(1, -1, np.int64)]
            head = lang.encode() + END
            self.keys += [head + w for w in distinct]
        self.codes = np.concatenate(codes) if codes else np.empty(0, np.int64)

    def words(self, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(order, hashes, counts) of the words, by buckets and in the order of their keys in each."""
        h = np.array([xxhash.xxh64_intdigest(k) for k in self.keys], dtype=np.uint64)
        by_key = np.array(sorted(range(len(self.keys)), key=self.keys.__getitem__), dtype=np.int64)
        order = by_key[np.argsort(h[by_key] >> np.uint64(64 - bits), kind="stable")]
        return order, h[order], np.bincount(self.codes[self.codes >= 0], minlength=len(self.keys))[order]


class Level:
    """What stands at each position of a block: the number of a name there, or -1, and a small number for it inside the block."""

    def __init__(self, local: np.ndarray, name: np.ndarray):
        self.local, self.name = local, name  # name: of each local number, -1 if it isn't frequent

    def pairs(self) -> Pairs:
        """Neighbours that are both frequent."""
        known = np.concatenate([self.name, [-1]])[self.local] >= 0 if len(self.local) else np.empty(0, bool)
        at = np.flatnonzero(known[:-1] & known[1:])
        key, back, n = np.unique(self.local[at] * max(1, len(self.name)) + self.local[at + 1], return_inverse=True, return_counts=True)
        return Pairs(self.name[key // max(1, len(self.name))], self.name[key % max(1, len(self.name))], n, at, back, len(self.local))


class Pairs:
    """Distinct pairs (left, right) of a block in the order of bucket hash, left, right."""

    def __init__(self, left: np.ndarray, right: np.ndarray, n: np.ndarray, at: np.ndarray, back: np.ndarray, size: int):
        h = left.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) ^ right.astype(np.uint64)
        for _ in range(2):
            h = h * np.uint64(0xD6E8FEB86659FD93)
            h ^= h >> np.uint64(32)
        self.hash, self.left, self.right, self.n, self.at, self.back, self.size = h, left, right, n, at, back, size

    def dealt(self, bits: int) -> list[tuple[int, np.ndarray]]:
        """(bucket, places of its pairs in the order of left and right)."""
        order = np.lexsort((self.right, self.left, self.hash >> np.uint64(64 - bits)))
        return [(k, order[a:e]) for k, (a, e) in spans(self.hash[order], bits)]

    def named(self, told: dict[int, bytes], bits: int) -> Level:
        name = np.full(len(self.left), -1, dtype=np.int64)
        for k, places in self.dealt(bits):
            name[places] = _names(told[k], len(places), k)
        local = np.full(self.size, -1, dtype=np.int64)
        local[self.at] = self.back
        return Level(local, name)


def _names(told: bytes, n: int, bucket: int) -> np.ndarray:
    """A bucket's answer: a bit for each asked pair, and by how much the number of each frequent one inside the bucket rises."""
    told, size = unsqueezed(told), -(-n // 8)
    yes = np.unpackbits(np.frombuffer(told, np.uint8, count=size), count=n).astype(bool)
    out = np.full(n, -1, dtype=np.int64)
    out[yes] = (bucket << 32) + np.cumsum(from_planes(told[size:], int(yes.sum()))[0]) if yes.any() else -1
    return out


def _coded(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, int, Coded]]:
    """Batches begin with block, lens, data, rest (lang of each document)."""
    for b in batches:
        for i in range(b.num_rows):
            yield b, i, Coded(b.column(3)[i].values.field(0).to_pylist(), b.column(1)[i].as_py(), b.column(2)[i].as_py())
            _give_back()


def _ask_words(bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, i, x in _coded(batches):
            order, h, n = x.words(bits)
            parts = spans(h, bits)
            data = [squeezed(planes(n[a:e]) + JOIN.join([x.keys[o] for o in order[a:e]])) for _, (a, e) in parts]
            yield _asked(b.column(0)[i].as_py(), [(k, e - a) for k, (a, e) in parts], data)

    return run


def _asked(block: int, parts: list[tuple[int, int]], data: list[bytes]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([k for k, _ in parts], pa.int32()), pa.array([block] * len(parts), pa.int64()), pa.array([n for _, n in parts], pa.int32()), pa.array(data, pa.binary())], ["bucket", "block", "n", "data"])


def _answer_words(least: int):
    """Names and answers of a bucket, and the number of words of each language in it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _grouped(batches):
            _give_back()
            bucket, asked, place, counts = t.column(0)[0].as_py(), [], {}, []
            for n, data in zip(t.column("n").to_pylist(), map(unsqueezed, t.column("data").to_pylist())):
                asked.append(np.array([place.setdefault(k, len(place)) for k in data[8 * n :].split(JOIN)], dtype=np.int64))
                counts.append(from_planes(data[: 8 * n], n)[0])
            total = np.zeros(len(place), np.int64)
            np.add.at(total, np.concatenate(asked), np.concatenate(counts))
            keys = [k.split(END, 1) for k in place]
            order = [i for _, i in sorted((k, i) for i, k in enumerate(place) if total[i] >= least)]
            yield from _told(t, bucket, asked, order, total, None, None, [keys[i][0].decode() for i in order], [keys[i][1].decode() for i in order])
            langs: dict[bytes, int] = {}
            for (lang, _), f in zip(keys, total.tolist()):
                langs[lang] = langs.get(lang, 0) + f
            yield _rows(TOTAL, len(langs), lang=[x.decode() for x in langs], f=list(langs.values()))

    return run


def _rows(kind: int, n: int, **cols: list) -> pa.RecordBatch:
    kinds = {"kind": pa.int32(), "block": pa.int64(), "bucket": pa.int32(), "data": pa.binary(), "id": pa.int64(), "left": pa.int64(), "right": pa.int64(), "lang": pa.string(), "word": pa.string(), "f": pa.int64()}
    return pa.RecordBatch.from_arrays([pa.array([kind] * n, k) if c == "kind" else pa.nulls(n, k) if cols.get(c) is None else pa.array(cols[c], k) for c, k in kinds.items()], list(kinds))


def _told(t: pa.Table, bucket: int, asked: list[np.ndarray], order: list[int], total: np.ndarray, left, right, lang=None, word=None, answers: bool = True) -> Iterator[pa.RecordBatch]:
    """Names of a bucket, numbered in this order, and the answer to each block that asked for these places."""
    number = np.full(len(total), -1, dtype=np.int64)
    number[order] = np.arange(len(order))
    for a in range(0, len(order), 1 << 16):
        e = min(a + (1 << 16), len(order))
        some = order[a:e]
        yield _rows(NAME, e - a, id=(bucket << 32) + np.arange(a, e), left=left if left is None else left[some], right=right if right is None else right[some], lang=lang and lang[a:e], word=word and word[a:e], f=total[some])
    if answers:
        data = [squeezed(np.packbits(x >= 0).tobytes() + planes(np.diff(x[x >= 0], prepend=0))) for x in (number[p] for p in asked)]
        yield _rows(ANSWER, len(data), block=t.column("block").to_pylist(), bucket=[bucket] * len(data), data=data)


def _ask_pairs(level: int, bits: int):
    """The pairs of the names of the level before; columns 4 and on are the answers of all levels before."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, i, x in _coded(batches):
            order, h, _ = x.words(bits)
            told, name = dict(b.column(4)[i].as_py() or ()), np.full(len(x.keys), -1, dtype=np.int64)
            for k, (a, e) in spans(h, bits):
                name[order[a:e]] = _names(told[k], e - a, k)
            now = Level(x.codes, name)
            for deeper in range(2, level):
                now = now.pairs().named(dict(b.column(3 + deeper)[i].as_py() or ()), bits)
            pairs = now.pairs()
            dealt = pairs.dealt(bits)
            yield _asked(b.column(0)[i].as_py(), [(k, len(p)) for k, p in dealt], [squeezed(planes(np.diff(pairs.left[p], prepend=0), pairs.right[p], pairs.n[p])) for _, p in dealt])

    return run


def _answer_pairs(least: int, answers: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _grouped(batches):
            _give_back()
            size = t.column("n").to_numpy()
            told = [from_planes(unsqueezed(d), k) for d, k in zip(t.column("data").to_pylist(), size.tolist())]
            left, right, n = np.concatenate([np.cumsum(x[0]) for x in told]), *(np.concatenate([x[i] for x in told]) for i in (1, 2))
            order = np.lexsort((right, left))
            new = np.ones(len(order), dtype=bool)
            new[1:] = (left[order][1:] != left[order][:-1]) | (right[order][1:] != right[order][:-1])
            place = np.empty(len(order), np.int64)
            place[order] = np.cumsum(new) - 1
            total = np.add.reduceat(n[order], np.flatnonzero(new)) if len(order) else n
            some = order[new]
            yield from _told(t, t.column(0)[0].as_py(), np.split(place, np.cumsum(size)[:-1]), np.flatnonzero(total >= least), total, left[some], right[some], answers=answers)

    return run


def names(docs: DataFrame, longest: int, least: int, block_bytes: int = 4 << 20, text: str = "text", lang: str = "lang") -> tuple[list[DataFrame], DataFrame]:
    """([words (id, lang, word, f), pairs (id, left, right, f), ...], (lang, n)): names of phrases of 1 to `longest` words that occur
    `least` times or more, and the number of words of each language. All are written tables."""
    spark = docs.sparkSession
    small_batches(spark)
    rows = docs.select(F.lit(None).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"), F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang"))
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = int(np.ceil(np.log2(max(64, total // (8 << 20)))))
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), min(100_000, total // (8 << 20)))
    known = _block_table(rows, block_bytes, tasks, ("lang",)).select("block", "lens", "data", "rest")
    out, totals = [], None
    for level in range(1, longest + 1):
        asked = known.mapInArrow(_ask_words(bits) if level == 1 else _ask_pairs(level, bits), ASK)
        told = written(_by_bucket(asked, 1 << bits).mapInArrow(_answer_words(least) if level == 1 else _answer_pairs(least, level < longest), TOLD), f"names-{level}")
        named = told.filter(F.col("kind") == NAME)
        out.append(named.select("id", "lang", "word", "f") if level == 1 else named.select("id", "left", "right", "f"))
        if level == 1:
            totals = told.filter(F.col("kind") == TOTAL).groupBy("lang").agg(F.sum("f").alias("n"))
        answers = told.filter(F.col("kind") == ANSWER).groupBy("block").agg(F.map_from_entries(F.collect_list(F.struct("bucket", "data"))).alias(f"told{level}"))
        known = known.join(answers.hint("shuffle_hash"), "block", "left")
    return out, totals


def collocations(docs: DataFrame, longest: int = 3, least: int = 10, share: int = 50, text: str = "text", lang: str = "lang", block_bytes: int = 4 << 20) -> DataFrame:
    """(lang, phrase, words, a, l, r, n, score): the phrases of 2 to `longest` words with a >= `least` occurrences in a language.

    Texts are lower-cased (A-Z) and split at `[.,;:!?\\x0A-\\x0D]`, pieces at spaces and tabs; phrases lie inside pieces. n: the
    language's words. Cut after k words, a phrase scores floor(10^6 a^2 / (l r)), where l and r are the occurrences of the two
    parts; the lowest-scoring cut counts, of equal ones the one with the least k. A phrase goes if a longer one with at least `share`
    percent of its occurrences holds it: that is so exactly if one that is longer by a word does, as what a phrase
    holds is at least as frequent. Null texts are empty, a null language is `und`; repeated rows each count; other
    columns are not read.
    """
    levels, totals = names(docs, longest, least, block_bytes, text, lang)
    none = F.array().cast("array<long>")
    told = written(levels[0].select("id", "lang", F.col("word").alias("phrase"), F.col("word").alias("last"), "f", none.alias("heads"), none.alias("tails")), "phrases-1")
    found = None
    for k, level in enumerate(levels[1:], 2):
        first = told.select(F.col("id").alias("left"), "lang", F.col("phrase").alias("head"), F.array_append("heads", F.col("f")).alias("heads"))
        then = told.select(F.col("id").alias("right"), "last", F.array_append("tails", F.col("f")).alias("tails"))
        half = written(spread_join(level, first, "left").drop("left"), f"heads-{k}")
        told = written(spread_join(half, then, "right").select("id", "lang", F.concat_ws(" ", "head", "last").alias("phrase"), "last", "f", "heads", "tails"), f"phrases-{k}")
        rows = told.select("id", "lang", "phrase", F.lit(k).alias("words"), F.col("f").alias("a"), "heads", "tails")
        if k < longest:  # the most frequent of the names that point to this one
            points = levels[k].select(F.explode(F.array("left", "right")).alias("id"), "f").groupBy("id").agg(F.max("f").alias("_most"))
            rows = rows.join(points, "id", "left").filter(F.coalesce(100 * F.col("_most") < share * F.col("a"), F.lit(True))).drop("_most")
        found = rows if found is None else found.unionByName(rows)

    cut = F.transform(F.sequence(F.lit(1), F.col("words") - 1), lambda j: F.struct(j.alias("k"), F.element_at("heads", j).alias("l"), F.element_at("tails", F.col("words") - j).alias("r")))
    cuts = found.withColumn("cut", F.explode(cut)).select("*", "cut.*")
    square = F.lit(10**6).cast("decimal(7,0)") * F.col("a").cast("decimal(15,0)") * F.col("a").cast("decimal(15,0)")
    cuts = cuts.withColumn("_square", square.cast("decimal(38,0)")).withColumn("_lr", (F.col("l").cast("decimal(19,0)") * F.col("r").cast("decimal(19,0)")).cast("decimal(38,0)"))
    scored = cuts.withColumn("best", F.struct(F.expr("_square div _lr").alias("score"), "k", "l", "r"))
    best = scored.groupBy("lang", "phrase", "words", "a").agg(F.min("best").alias("best"))
    return best.join(totals.withColumnRenamed("lang", "_lang"), F.col("lang") == F.col("_lang")).select("lang", "phrase", "words", "a", "best.l", "best.r", "n", "best.score")


def op11_pair_naming(spark, sf_dir):
    """Each language's first 2000 collocations of 2 to 3 words: lang, rank, phrase, a, l, r, n, score.

    Ranked by score, then a (falling), then phrase in UTF-8 byte order. A language's rows are ranked in parts first, so that
    the task that ranks it in the end has 64 times 2000 rows at most.
    """
    found = collocations(table(spark, sf_dir, "documents"))
    order = (F.desc("score"), F.desc("a"), "phrase")
    part = F.pmod(F.xxhash64("phrase"), F.lit(64))
    first = found.withColumn("part", part).withColumn("rank", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order))).filter("rank <= 2000")
    ranked = first.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).filter("rank <= 2000")
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


#: Windows of two and three words of each piece; products are of 128 bits.
OP11_SQL = r"""
WITH d AS (SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
p AS (SELECT lang, unnest(string_split_regex(t, '[.,;:!?\x0A-\x0D]')) AS piece FROM d),
q AS MATERIALIZED (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM p),
g1 AS MATERIALIZED (SELECT lang, u AS phrase, count(*)::HUGEINT AS f FROM (SELECT lang, unnest(w) AS u FROM q) GROUP BY ALL),
g2 AS MATERIALIZED (SELECT lang, x, y, count(*)::HUGEINT AS f FROM (SELECT lang, unnest(w[:-2]) AS x, unnest(w[2:]) AS y FROM q WHERE len(w) > 1) GROUP BY ALL),
g3 AS MATERIALIZED (SELECT lang, x, y, z, count(*)::HUGEINT AS f FROM (SELECT lang, unnest(w[:-3]) AS x, unnest(w[2:-2]) AS y, unnest(w[3:]) AS z FROM q WHERE len(w) > 2) GROUP BY ALL),
n AS MATERIALIZED (SELECT lang, sum(f)::BIGINT AS n FROM g1 GROUP BY lang),
c3 AS MATERIALIZED (SELECT * FROM g3 WHERE f >= 10),
m AS MATERIALIZED (SELECT lang, x, y, max(f) AS most FROM (SELECT lang, x, y, f FROM c3 UNION ALL SELECT lang, y, z, f FROM c3) GROUP BY ALL),
s2 AS (SELECT g2.lang, g2.x || ' ' || g2.y AS phrase, g2.f AS a, u.f AS l, v.f AS r, (1000000 * g2.f * g2.f) // (u.f * v.f) AS score FROM g2 JOIN g1 u ON u.lang = g2.lang AND u.phrase = g2.x JOIN g1 v ON v.lang = g2.lang AND v.phrase = g2.y LEFT JOIN m ON m.lang = g2.lang AND m.x = g2.x AND m.y = g2.y WHERE g2.f >= 10 AND coalesce(100 * most < 50 * g2.f, true)),
k3 AS (SELECT c3.lang, c3.x || ' ' || c3.y || ' ' || c3.z AS phrase, c3.f AS a, u.f AS l1, v.f AS r1, (1000000 * c3.f * c3.f) // (u.f * v.f) AS s1, i.f AS l2, j.f AS r2, (1000000 * c3.f * c3.f) // (i.f * j.f) AS s2 FROM c3 JOIN g1 u ON u.lang = c3.lang AND u.phrase = c3.x JOIN g2 v ON v.lang = c3.lang AND v.x = c3.y AND v.y = c3.z JOIN g2 i ON i.lang = c3.lang AND i.x = c3.x AND i.y = c3.y JOIN g1 j ON j.lang = c3.lang AND j.phrase = c3.z),
a AS (SELECT lang, phrase, a, l, r, score FROM s2 UNION ALL SELECT lang, phrase, a, CASE WHEN s1 <= s2 THEN l1 ELSE l2 END, CASE WHEN s1 <= s2 THEN r1 ELSE r2 END, least(s1, s2) FROM k3),
o AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank FROM a)
SELECT lang, rank::BIGINT AS rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n, score::BIGINT AS score FROM o JOIN n USING (lang) WHERE rank <= 2000
"""
