"""Token counts with a byte-pair vocabulary compiled to a finite-state transducer.

The last token of the encoding of a prefix is the one suffix piece that stands validly behind the last token before it, so
the encoder needs but the pieces that may still be going on: a finite state. States are made when first met
(lazy determinisation); each transition carries the change of the token count. Between two characters that no piece
holds side by side the transducer is back at its start, whatever came before. A chunk of a long text is a state map: for
the state it is entered in, the state it is left in and the tokens counted. Behind its first reset a map is constant;
before it, the map is worked out for the state that the characters before the chunk lead to, and for any other state when
that is asked for. Maps compose associatively: behind a reset in the first the second's entry is known, and without one the
second's text before its reset goes on the first's. So chunks of a long text are rows that tasks turn into maps side by side,
and a tree of groups composes the maps.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trajlake.llm.common import utf8

BAR = "▁"  # the vocabulary's stand-in for a blank
RESET = re.compile(f"[^{BAR}]{BAR}")
CHUNK = 1 << 16
WARM = 64  # characters before a chunk that tell the state it is likely entered in
KEPT_WORDS, KEPT_CHARS, KEPT_STATES, KEPT_HOPS = 600_000, 32, 150_000, 500_000
START = (("", None, 0),)


class ChunkMap(NamedTuple):
    """(entry state) -> (exit state, tokens): text before the first reset, what stands behind it, and answers known so far."""

    before: str
    head: str
    body: int
    exit: tuple | None  # None: there is no reset
    known: dict


class Composed(NamedTuple):
    """First the one map, then the other."""

    first: "ChunkMap | Composed"
    then: "ChunkMap | Composed"
    known: dict


class Transducer:
    def __init__(self, scores: dict[str, float]):
        self.scores = scores
        self.prefixes = {p[:i] for p in scores for i in range(1, len(p))}
        self.joined = {p[i : i + 2] for p in scores for i in range(len(p) - 1)}
        if any(x[1] == BAR != x[0] for x in self.joined):
            raise ValueError("a piece has a blank behind another character; words are not separable")
        self._clear()
        outer = self

        class Words(dict):
            def __missing__(self, word: str) -> int:
                n = outer.run(BAR + word)[1]
                if len(word) <= KEPT_CHARS:
                    if len(self) >= KEPT_WORDS:
                        self.clear()
                    self[word] = n
                return n

        self.words = Words()

    def _clear(self) -> None:
        self.ids, self.states, self.delta, self.hops = {}, [], [], 0
        self._valid: dict[tuple[str | None, str], bool] = {}
        self._state(START)

    def _state(self, entries: tuple) -> int:
        at = self.ids.setdefault(entries, len(self.states))
        if at == len(self.states):
            self.states.append(entries)
            self.delta.append({})
        return at

    def merge(self, text: str) -> list[str]:
        """The encoding by its definition: merge the best pair, the leftmost of equals, until none is left."""
        s = list(text)
        while True:
            best = None
            for i in range(len(s) - 1):
                x = self.scores.get(s[i] + s[i + 1])
                if x is not None and (best is None or x > best[0]):
                    best = (x, i)
            if best is None:
                return s
            s[best[1] : best[1] + 2] = [s[best[1]] + s[best[1] + 1]]

    def weight(self, token: str) -> int:
        """Tokens that a piece counts for: one, or its bytes if it's a character that is no piece."""
        return 1 if token in self.scores else len(token.encode("utf-8", "surrogatepass"))

    def valid(self, before: str | None, token: str) -> bool:
        known = self._valid.get((before, token))
        if known is None:
            known = self.merge((before or "") + token) == ([token] if before is None else [before, token])
            self._valid[before, token] = known
        return known

    def _step(self, state: int, c: str) -> tuple[int, int]:
        entries = self.states[state]
        for going, before, rel in entries:  # the longest first
            token = going + c
            if (not going or token in self.scores) and self.valid(before, token):
                emitted = rel + self.weight(token)
                break
        else:
            raise AssertionError(f"no encoding ends with {c!r}")
        nxt = tuple((g + c, b, r - emitted) for g, b, r in entries if g + c in self.prefixes)
        return self._state((*nxt, ("", token, 0))), emitted

    def run(self, text: str, entries: tuple = START, before: str = "") -> tuple[tuple, int]:
        """(exit state, tokens) of a text that is entered in a state, behind the character before.

        What the transducer keeps is dropped when it is too much, also inside a text.
        """
        state, total, prev, delta, joined = self._state(entries), 0, before, self.delta, self.joined
        for c in text:
            if prev and prev + c not in joined:
                state = 0
            hop = delta[state].get(c)
            if hop is None:
                if len(self.states) > KEPT_STATES or self.hops > KEPT_HOPS:
                    here = self.states[state]
                    self._clear()
                    delta = self.delta
                    state = self._state(here)
                self.hops += 1
                hop = delta[state][c] = self._step(state, c)
            state = hop[0]
            total += hop[1]
            prev = c
        return self.states[state], total

    def segment(self, text: str) -> int:
        """Tokens of a text that is entered in the start state."""
        return self.run(text)[1]

    def _count(self, text: str) -> int:
        """Tokens of a text that begins with a blank and is entered in the start state, word by word."""
        words = text.split(BAR)
        if "" not in words[1:]:
            return sum(map(self.words.__getitem__, words[1:]))
        total, blanks = 0, -1  # runs of blanks stay with the word behind them
        for w in words[1:]:
            blanks += 1
            if w:
                total += self.words[BAR * blanks + w]
                blanks = -1
        return total + (self.words[BAR * blanks] if blanks >= 0 else 0)

    def chunk_map(self, chunk: str, before: str = "", warm: str = "") -> ChunkMap:
        """The map of a chunk with blanks as BAR. before: the character in front of it; warm: some characters in front."""
        if chunk[:1] == BAR and before != BAR:
            first = 0
        else:
            found = RESET.search(chunk)
            first = found.start() + 1 if found else len(chunk)
        if first == len(chunk):
            made = ChunkMap(before, chunk, 0, None, {})
        else:
            last = len(chunk)
            while True:
                last = chunk.rfind(BAR, first, last)
                if last == first or chunk[last - 1] != BAR:
                    break
            exit, n = self.run(chunk[last:])
            made = ChunkMap(before, chunk[:first], n + (self._count(chunk[first:last]) if last > first else 0), exit, {})
        if made.head:
            self.apply(made, self.run(warm)[0])
        return made

    def compose(self, a: "ChunkMap | Composed", b: "ChunkMap | Composed") -> Composed:
        """First a, then b, worked out for the states that a is known for."""
        made = Composed(a, b, {})
        for entry in list(a.known):
            self.apply(made, entry)
        return made

    def joined_map(self, a: ChunkMap, b: ChunkMap) -> ChunkMap:
        """First a, then b, as one map: behind a reset in a, b's entry is known; without one its head goes on."""
        if a.exit is None:
            return ChunkMap(a.before, a.head + b.head, a.body + b.body, b.exit, {})
        exit, n = self.apply(b, a.exit)
        return ChunkMap(a.before, a.head, a.body + n, exit, {})

    def apply(self, m: "ChunkMap | Composed", entry: tuple) -> tuple[tuple, int]:
        """(exit state, tokens) of a map for the state that it is entered in."""
        if isinstance(m, ChunkMap) and not m.head:
            return (entry if m.exit is None else m.exit), m.body
        got = m.known.get(entry)
        if got is None:
            if isinstance(m, Composed):
                middle, n = self.apply(m.first, entry)
                exit, more = self.apply(m.then, middle)
                got = exit, n + more
            else:
                exit, n = self.run(m.head, entry, m.before)
                got = (exit if m.exit is None else m.exit), n + m.body
            m.known[entry] = got
        return got

    def count(self, text: str) -> int:
        """Tokens of a whole text, with the blank that the vocabulary puts before it."""
        if not text:
            return 0
        s = BAR + text.replace(" ", BAR)
        if len(s) <= CHUNK:
            return self._count(s)
        maps = [self.chunk_map(s[i : i + CHUNK], s[i - 1 : i], s[max(0, i - WARM) : i]) for i in range(0, len(s), CHUNK)]
        return self.apply(scanned(maps, self.compose), START)[1]


def scanned(maps: list, compose):
    """The composition of all maps, by pairs of neighbours, pairs of pairs and so on."""
    while len(maps) > 1:
        maps = [compose(*maps[i : i + 2]) if i + 1 < len(maps) else maps[i] for i in range(0, len(maps), 2)]
    return maps[0]


def load_pieces(model_path: str) -> dict[str, float]:
    """Pieces and scores of a vocabulary file whose normaliser leaves texts alone but for a blank before them."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=model_path)
    if sp.encode(" a  b ", out_type=str) != sp.encode(" a  b ".replace(" ", BAR), out_type=str) or "".join(sp.encode(" a  b\u00bd ", out_type=str)) != BAR + " a  b\u00bd ".replace(" ", BAR):
        raise ValueError("only vocabularies with the identity normaliser and a blank before the text are compiled")
    plain = [i for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
    return {sp.id_to_piece(i): sp.get_score(i) for i in plain}


_made: dict[str, Transducer] = {}


def transducer(model_path: str) -> Transducer:
    """One transducer for each file and process; what it has learned of words is kept between batches, within bounds."""
    if model_path not in _made:
        _made[model_path] = Transducer(load_pieces(model_path))
    return _made[model_path]


def token_counts(docs: DataFrame, model_path: str, chunk: int | None = None) -> DataFrame:
    """(doc_id, n_bytes, n_tokens): UTF-8 bytes and tokens of every whole text, as the vocabulary's library counts.

    No begin, end or special tokens are added and their strings in a text are ordinary text. Null counts as empty: no
    bytes, no tokens. Every row has a result, repeated ids too; other columns are not read. model_path is opened on the
    executors and has to be there on each. A text of up to `chunk` bytes is counted where it is. A longer one is dealt out in chunks
    of so many characters, which tasks turn into state maps side by side; the maps are composed FAN at a time, level
    by level. What is kept of words and states between texts is bounded.
    """
    chunk = chunk or CHUNK

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = transducer(model_path)
        for b in batches:
            texts = b.column(1).to_pylist()
            n = [t.count(x.decode("utf-8", "replace")) for x in texts]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(map(len, texts), pa.int64()), pa.array(n, pa.int64())], ["doc_id", "n_bytes", "n_tokens"])

    rows = docs.select(F.col("doc_id").cast("long"), utf8(F.col("text")).alias("t"))
    short = rows.filter(F.octet_length("t") <= chunk).mapInArrow(run, "doc_id long, n_bytes long, n_tokens long")
    longest = rows.agg(F.max(F.octet_length("t"))).first()[0] or 0
    if longest <= chunk:
        return short
    return short.unionByName(long_counts(rows.filter(F.octet_length("t") > chunk), model_path, chunk, longest))


FAN = 64
KEY = ["doc_id", "n_bytes", "k1", "k2"]
MAP = "doc_id long, n_bytes long, k1 long, k2 long, copies long, no long, before string, head string, body long, exit string"


def long_counts(rows: DataFrame, model_path: str, chunk: int, longest: int) -> DataFrame:
    """token_counts of rows (doc_id, t), none over `longest` bytes, by a scan of chunks.

    A text is known by its id, its size and 128 bits, so that rows that repeat are worked out once.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, raw in enumerate(b.column(4).to_pylist()):
                s = BAR + raw.decode("utf-8", "replace").replace(" ", BAR)
                key = [b.column(c)[i].as_py() for c in range(4)]
                for no, at in enumerate(range(0, len(s), chunk)):
                    row = [*key, no, s[max(0, at - 1) : at], s[max(0, at - WARM) : at], s[at : at + chunk]]
                    yield pa.RecordBatch.from_arrays([pa.array([v], pa.int64() if k < 5 else pa.string()) for k, v in enumerate(row)], [*KEY, "no", "before", "warm", "chunk"])

    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = transducer(model_path)
        for b in batches:
            made = [t.chunk_map(c, before, warm) for before, warm, c in zip(*(b.column(i).to_pylist() for i in (6, 7, 8)))]
            yield pa.RecordBatch.from_arrays([*b.columns[:6], *map_columns(made)], [*KEY, "copies", "no", "before", "head", "body", "exit"])

    def composed(t: pa.Table) -> pa.Table:
        t, of = t.sort_by("no"), transducer(model_path)
        maps = [ChunkMap(x, head, body, None if out is None else state_of(out), {}) for x, head, body, out in zip(*(t.column(c).to_pylist() for c in ("before", "head", "body", "exit")))]
        made = maps[0]
        for m in maps[1:]:
            made = of.joined_map(made, m)
        own = t.slice(0, 1)
        no = pa.array([own.column("no")[0].as_py() // FAN], pa.int64())
        return pa.Table.from_arrays([*(own.column(c) for c in [*KEY, "copies"]), no, *map_columns([made])], [*KEY, "copies", "no", "before", "head", "body", "exit"])

    known = rows.select("doc_id", F.octet_length("t").cast("long").alias("n_bytes"), F.xxhash64("t").alias("k1"), F.xxhash64("t", F.lit(1)).alias("k2"), "t")
    pieces = known.mapInArrow(cut, "doc_id long, n_bytes long, k1 long, k2 long, no long, before string, warm string, chunk string")
    one = pieces.groupBy(*KEY, "no").agg(F.count("*").alias("copies"), *[F.first(c).alias(c) for c in ("before", "warm", "chunk")])
    maps = one.select(*KEY, "copies", "no", "before", "warm", "chunk").mapInArrow(mapped, MAP)
    chunks = -(-(longest + 1) // chunk)
    while chunks > 1:
        maps = maps.groupBy(*KEY, F.expr(f"no div {FAN}")).applyInArrow(composed, MAP)
        chunks = -(-chunks // FAN)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = transducer(model_path)
        for b in batches:
            maps = [ChunkMap(x, head, body, None if out is None else state_of(out), {}) for x, head, body, out in zip(*(b.column(c).to_pylist() for c in (3, 4, 5, 6)))]
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array([t.apply(m, START)[1] for m in maps], pa.int64())], ["doc_id", "n_bytes", "copies", "n_tokens"])

    found = maps.select("doc_id", "n_bytes", "copies", "before", "head", "body", "exit").mapInArrow(counted, "doc_id long, n_bytes long, copies long, n_tokens long")
    return found.select("doc_id", "n_bytes", "n_tokens", F.explode(F.sequence(F.lit(1).cast("long"), "copies")).alias("copy")).drop("copy")


def map_columns(maps: list[ChunkMap]) -> list[pa.Array]:
    """before, head, body and exit of maps; a state is written as JSON."""
    return [pa.array([m.before for m in maps], pa.string()), pa.array([m.head for m in maps], pa.string()), pa.array([m.body for m in maps], pa.int64()), pa.array([None if m.exit is None else json.dumps(m.exit) for m in maps], pa.string())]


def state_of(text: str) -> tuple:
    return tuple(map(tuple, json.loads(text)))


def op8_token_counts(spark, sf_dir, limit: int = 4096):
    """Bytes and tokens of every whole document, null counting as empty, and whether it has over limit tokens."""
    import public_tokenizers

    from trajlake.llm.common import table

    counted = token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
