"""Packing documents into sequences by cutting-stock column generation.

Documents are cut into full sequences and one rest. The lengths of all pieces, in classes of ``UNIT`` tokens, make a histogram of
at most ``sequence / UNIT`` counts, whatever the input; it is all that reaches the driver. There a linear program over patterns (how
many pieces of each class share a sequence) is solved by column generation: dual prices of the classes, a knapsack dynamic
program that finds the pattern worth most, one pivot, until no pattern is worth noticeably more than a sequence. Patterns are
rounded down, then up where pieces are left; what remains is packed best fit decreasing. Pieces are ranked in their class,
and ranges of ranks stand for the places of a pattern, so the assignment is one look-up per piece.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trustloom.llm.common import documents, numbered
from trustloom.llm.sharding import best_fit_decreasing
from trustloom.llm.words import slices, text_bytes, word_bounds, word_hashes
from trustloom.session import staged

SEQUENCE = 2048
UNIT = 16
END_ID = 1
KNOWN_WORDS = 1_000_000
ENCODED_TOGETHER = 5_000
GAP = 2e-3
ROUNDS = 1_500
PIECES = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, ids binary"


class WordEncoder:
    """Token ids of texts, one word at a time.

    It holds for tokenizers whose normaliser and splitter never look across ASCII white space, as the one used here: a text's
    ids are then those of its words in a row. Words seen before come from sorted arrays of bounded size, found by their 64-bit
    hash; new ones are encoded together, with a mark of one id between them.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        self.mark, self.mark_id = next((c, ids[0]) for c in "\u00a7\u00b6\u00a4|~" if len(ids := self._ids(c)) == 1)
        self._forget()

    def _forget(self) -> None:
        none = np.zeros(0, np.int64)
        self.main = self.fresh = (np.zeros(0, np.uint64), none, none)
        self.ids, self.used = np.zeros(1 << 20, dtype="<u4"), 0

    def _ids(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def _learn(self, words: list[bytes]) -> list[np.ndarray]:
        mark = self.mark.encode()
        plain = [k for k, w in enumerate(words) if mark not in w]
        out = [np.array(self._ids(w.decode()), dtype="<u4") if mark in w else None for w in words]
        for at in range(0, len(plain), ENCODED_TOGETHER):
            some = plain[at:at + ENCODED_TOGETHER]
            text = f" {self.mark} ".join(words[k].decode() for k in some)
            ids = np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, dtype="<u4")
            ends = np.append(np.flatnonzero(ids == self.mark_id), len(ids)).tolist()
            first = 0
            for k, end in zip(some, ends, strict=True):
                out[k] = ids[first:end]
                first = end + 1
        return out

    def _store(self, parts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        sizes = np.array([len(x) for x in parts], dtype=np.int64)
        starts = self.used + np.cumsum(sizes) - sizes
        total = int(sizes.sum())
        if self.used + total > len(self.ids):
            self.ids = np.concatenate([self.ids[:self.used], np.zeros(self.used + 2 * total + (1 << 20), dtype="<u4")])
        if total:
            self.ids[self.used:self.used + total] = np.concatenate(parts)
        self.used += total
        return starts, sizes

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts of a column in a row, and where each text's ids start (one entry more than texts)."""
        data, offsets = text_bytes(column)
        first, last, borders = word_bounds(data, offsets)
        words, at, place = np.unique(word_hashes(data, first, last), return_index=True, return_inverse=True)
        if len(self.main[0]) + len(self.fresh[0]) + len(words) > KNOWN_WORDS or self.used > 8 * KNOWN_WORDS:
            self._forget()
        start, size = np.zeros(len(words), np.int64), np.full(len(words), -1)
        for known, starts, sizes in (self.main, self.fresh):
            if len(known):
                k = np.minimum(np.searchsorted(known, words), len(known) - 1)
                hit = known[k] == words
                start[hit], size[hit] = starts[k[hit]], sizes[k[hit]]
        new = np.flatnonzero(size < 0)
        if len(new):
            raw = data.tobytes()
            start[new], size[new] = self._store(self._learn([raw[a:b] for a, b in zip(first[at[new]].tolist(), last[at[new]].tolist())]))
            self.fresh = _merged(self.fresh, (words[new], start[new], size[new]))
            if 4 * len(self.fresh[0]) > len(self.main[0]):
                self.main, self.fresh = _merged(self.main, self.fresh), tuple(x[:0] for x in self.fresh)
        counts = size[place]
        ends = np.concatenate([[0], np.cumsum(counts)])
        ids = self.ids[np.arange(ends[-1]) + np.repeat(start[place] - ends[:-1], counts)]
        return ids, ends[borders]


def _merged(a: tuple, b: tuple) -> tuple:
    """Two tables with different keys as one, in order of key."""
    order = np.argsort(np.concatenate([a[0], b[0]]), kind="stable")
    return tuple(np.concatenate([x, y])[order] for x, y in zip(a, b))


_encoders: dict[str, WordEncoder] = {}


def word_encoder(path: str) -> WordEncoder:
    """The encoder of this Python worker; its table outlives a task."""
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]


def id_type(tokenizer: str, end_id: int) -> str:
    """Two bytes an id if the vocabulary fits, else four."""
    from tokenizers import Tokenizer
    return "<u2" if max(end_id + 1, Tokenizer.from_file(tokenizer).get_vocab_size()) <= 1 << 16 else "<u4"


def unpacked_ids(ids: bytes, tokenizer: str, end_id: int = END_ID) -> np.ndarray:
    """The ids of a piece as numbers."""
    return np.frombuffer(ids, id_type(tokenizer, end_id)).astype(np.int32)


def token_pieces(docs: DataFrame, tokenizer: str, sequence: int, end_id: int, with_ids: bool, text: str, doc_id: str) -> DataFrame:
    """Pieces of at most ``sequence`` ids: all full but the last of a document. ``ids`` are little-endian numbers of ``id_type``."""
    schema = PIECES if with_ids else PIECES.rsplit(",", 1)[0]
    end, kind = np.array([end_id], dtype="<u4").tobytes(), id_type(tokenizer, end_id)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = word_encoder(tokenizer)
        for batch in batches:
            for part in slices(batch, "text"):
                rows: list[tuple] = []
                all_ids, borders = encoder.encode(part.column("text"))
                for key, a, b in zip(part.column("doc_id").to_pylist(), borders[:-1].tolist(), borders[1:].tolist()):
                    ids = all_ids[a:b].tobytes() + end
                    n = len(ids) // 4
                    for at in range(0, n, sequence):
                        piece = ids[4 * at:4 * (at + sequence)]
                        row = (key, at, len(piece) // 4, zlib.crc32(piece), n)
                        rows.append((*row, np.frombuffer(piece, "<u4").astype(kind).tobytes()) if with_ids else row)
                columns = list(zip(*rows))
                arrays = [pa.array(c, pa.int64()) for c in columns[:5]]
                if with_ids:
                    arrays.append(pa.array(columns[5], pa.binary()))
                yield pa.RecordBatch.from_arrays(arrays, [f.split()[0] for f in schema.split(", ")])
    return docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text")).mapInArrow(cut, schema)


def best_pattern(units: np.ndarray, prices: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """The multiset of classes of at most ``capacity`` units that is worth most: an unbounded knapsack.

    The worth of up to 2, 4, 8, ... pieces is the best split of the room between two halves of as many pieces.
    """
    worth, item = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    gain = prices > 0
    worth[units[gain]], item[units[gain]] = prices[gain], np.flatnonzero(gain)
    room = np.arange(capacity + 1)
    other = room[:, None] - room[None, :]
    splits, most = [], 1
    while most * int(units[0]) < capacity:
        table = np.where(other >= 0, worth[None, :] + worth[other], -1.0)
        splits.append(table.argmax(axis=1))
        worth, most = table[room, splits[-1]], most * 2
    pattern, parts = np.zeros(len(units)), np.array([int(worth.argmax())])
    for split in reversed(splits):
        parts = np.concatenate([split[parts], parts - split[parts]])
    for i in item[parts]:
        if i >= 0:
            pattern[i] += 1
    return float(worth.max()), pattern


def pattern_program(units: np.ndarray, demand: np.ndarray, capacity: int, gap: float = GAP, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray]:
    """Patterns (columns) and how often each is used, so that the demand is met with the fewest sequences up to ``gap``."""
    alone = (capacity // units).astype(float)
    base, inverse, used = np.diag(alone), np.diag(1 / alone), demand / alone
    for _ in range(rounds):
        prices = inverse.sum(axis=0)
        worth, pattern = best_pattern(units, prices, capacity)
        if worth <= 1 + gap:
            break
        step = (inverse * pattern).sum(axis=1)
        falls = step > 1e-10
        ratios = np.full(len(units), np.inf)
        ratios[falls] = used[falls] / step[falls]
        leave = int(ratios.argmin())
        by = ratios[leave]
        used = np.maximum(used - by * step, 0.0)
        used[leave] = by
        base[:, leave] = pattern
        row = inverse[leave] / step[leave]
        inverse = inverse - step[:, None] * row
        inverse[leave] = row
    return base, used


def pattern_places(units: np.ndarray, counts: np.ndarray, capacity: int) -> dict[str, np.ndarray]:
    """Runs ``(class, first rank, first sequence, per sequence)``: where the pieces of a class go, in order of class and rank."""
    patterns, used = pattern_program(units, counts.astype(float), capacity)
    left, given, runs, sequences = counts.copy(), np.zeros(len(units), dtype=np.int64), [], 0

    def place(pattern: np.ndarray, times: int) -> None:
        nonlocal sequences
        held = np.flatnonzero(pattern)
        times = min(times, int((left[held] // pattern[held]).min()))
        if times > 0:
            for c in held:
                runs.append((units[c], given[c], sequences, pattern[c]))
                given[c] += times * pattern[c]
                left[c] -= times * pattern[c]
            sequences += times
    whole = patterns.astype(np.int64)
    for j in range(len(units)):
        place(whole[:, j], int(used[j] + 1e-9))
    for j in np.argsort(np.floor(used) - used, kind="stable"):
        if used[j] - np.floor(used[j]) > 0.5:
            place(whole[:, j], 1)
    heavy = np.argsort(-units, kind="stable")
    heavy = heavy[left[heavy] > 0]
    if len(heavy):
        rest, opened = best_fit_decreasing(units[heavy], left[heavy], capacity)
        begins = np.cumsum(left[heavy]) - left[heavy]
        for position, first, per in rest.tolist():
            c = int(np.searchsorted(begins, position, side="right")) - 1
            runs.append((units[heavy[c]], given[heavy[c]] + position - begins[c], sequences + first, per))
        sequences += opened
    runs.sort()
    table = np.array(runs, dtype=np.int64).reshape(-1, 4)
    return {"unit": table[:, 0], "rank": table[:, 1], "sequence": table[:, 2], "per": table[:, 3]}


def _sequence_of(runs: dict[str, np.ndarray], counts: dict[int, int]):
    offsets, total = {}, 0
    for unit in sorted(counts):
        offsets[unit] = total
        total += counts[unit]
    base = np.zeros(max(offsets, default=0) + 1, dtype=np.int64)
    base[list(offsets)] = list(offsets.values())
    starts, first, per, rank = base[runs["unit"]] + runs["rank"], runs["sequence"], runs["per"], runs["rank"]

    @F.pandas_udf("bigint")
    def sequence_of(unit: pd.Series, number: pd.Series) -> pd.Series:
        number = number.to_numpy()
        run = np.searchsorted(starts, base[unit.to_numpy()] + number, side="right") - 1
        return pd.Series(first[run] + (number - rank[run]) // per[run])
    return sequence_of


def packed(docs: DataFrame, tokenizer: str, sequence: int = SEQUENCE, unit: int = UNIT, end_id: int = END_ID,
           with_ids: bool = False, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row per piece: ``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset`` and, if asked for, ``ids`` as bytes:
    little-endian unsigned numbers of :func:`id_type`, which :func:`unpacked_ids` reads.

    A document is its ids and ``end_id``; null text is empty and so has that id alone. Pieces of a document are full sequences and
    one rest, every id in exactly one piece. Long texts only have more pieces. Rows that repeat an id are packed like others, null
    ids too; other columns are not read. An empty table gives no rows. A sequence holds whole pieces, gapless from 0.
    """
    pieces = token_pieces(docs, tokenizer, sequence, end_id, with_ids, text, doc_id)
    pieces = staged(pieces.withColumn("unit", F.ceil(F.col("length") / F.lit(unit)).cast("int"))
                    .withColumn("piece", F.monotonically_increasing_id()), "pieces")  # numbers are fixed with the table
    slim = pieces.drop("ids")
    counts = slim.groupBy("unit").agg(F.count(F.lit(1)).alias("n"))
    found = {r["unit"]: r["n"] for r in counts.toPandas().to_dict("records")}  # at most sequence / unit classes
    if found:
        units = np.array(sorted(found), dtype=np.int64)
        runs = pattern_places(units, np.array([found[u] for u in units.tolist()], dtype=np.int64), -(-sequence // unit))
        ranked = numbered(slim, "unit", counts, ["doc_id", "start", "ids_crc32", "piece"], "number")
        placed = ranked.withColumn("sequence_id", _sequence_of(runs, found)("unit", "number"))
        inside = Window.partitionBy("sequence_id").orderBy(F.desc("unit"), "number").rowsBetween(Window.unboundedPreceding, -1)
        placed = placed.withColumn("offset", F.coalesce(F.sum("length").over(inside), F.lit(0))).drop("unit", "number")
    else:
        placed = slim.drop("unit").withColumns({"sequence_id": F.lit(0).cast("bigint"), "offset": F.lit(0).cast("bigint")})
    if not with_ids:
        return placed.drop("piece")
    # Only here do the ids move, and once.
    return placed.join(pieces.select("piece", "ids"), "piece").drop("piece")


def vocabulary_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers
    return public_tokenizers.path(name)


def op7_packed(spark, sf_dir: str) -> DataFrame:
    return packed(documents(spark, sf_dir), vocabulary_path())


QUERIES = {"op7_packed": op7_packed}
ORACLE: dict[str, str] = {}
