"""Best-fit packing: hierarchical residual packing.

Documents become token sequences (a public tokenizer's ids, then an end id); only those longer than a sequence are
cut, into full pieces and a rest.  Every partition packs its own pieces best-fit, longest first.  Bins that are nearly
full are emitted; the underfull ones become items of the next round, in which a few partitions' bins meet in one task
and are packed best-fit again, until one task remains (tree merge).  Places are then summed up along the tree.

Only piece lengths move; ids never leave the task that made them.  A task holds the piece lengths of one input split
(first round) or of the underfull bins of `FAN_IN` tasks at most `LEVELS * FAN_IN` of each fill, which is all that merges
can use (see carried), so no task of the tree grows with the table.

Defined results: a null or empty text is one piece with only the end id; null doc_ids are packed too; repeated rows are packed
each on its own; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import json
import re
import zlib

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import small_batches, widened, written

CAPACITY = 4096
END_ID = 1
FAN_IN = 16
LEVELS = 5  # of the tree, up to a million tasks
NEARLY_FULL = 4064  # emitted at once; the rest of the bins goes up the tree
CACHE_WORDS = 250_000  # two generations of so many are kept
_TOKENIZERS: dict[str, object] = {}


class WordBpe:
    """Byte-pair merges of many words at once, by numpy.

    Words of one length advance together: every step merges the best pair of every unfinished word, so these keep
    one length and form a matrix.  The rules are those of the tokenizer's file."""

    NONE = np.int32(1 << 30)

    def __init__(self, model: dict):
        vocab = model["vocab"]
        suffix = model.get("end_of_word_suffix") or ""
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
        letters = {b: chr(b) for b in printable}
        letters |= {b: chr(256 + n) for n, b in enumerate(b for b in range(256) if b not in letters)}
        self.first = np.array([vocab[letters[b]] for b in range(256)], np.int32)
        self.last = np.array([vocab[letters[b] + suffix] for b in range(256)], np.int32)
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        keys = np.array([(vocab[a] << 20) | vocab[b] for a, b in merges], np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks = keys[order], order.astype(np.int32)
        self.result = np.array([vocab[a + b] for a, b in merges], np.int32)
        one = np.concatenate((self.first, self.last))
        self.dense = self.rank(np.repeat(one, 512), np.tile(one, 512)).reshape(512, 512)

    def rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = (a.astype(np.int64) << 20) | b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], self.NONE)

    def encode(self, words: list[bytes]) -> list[bytes]:
        out: list[bytes] = [b""] * len(words)
        by_length: dict[int, list[int]] = {}
        for k, w in enumerate(words):
            by_length.setdefault(len(w), []).append(k)
        for length, which in by_length.items():
            rows = np.array(which)
            raw = np.frombuffer(b"".join([words[k] for k in which]), np.uint8).reshape(-1, length).astype(np.int64)
            raw[:, -1] += 256
            symbols = np.where(raw < 256, self.first[raw & 255], self.last[raw & 255])
            rank = self.dense[raw[:, :-1], raw[:, 1:]]
            while True:
                width = symbols.shape[1]
                if width > 1:
                    at = rank.argmin(1)
                    best = np.take_along_axis(rank, at[:, None], 1)[:, 0]
                    going = best < self.NONE
                else:
                    going = np.zeros(len(rows), bool)
                if not going.all():
                    for k, ids in zip(rows[~going].tolist(), symbols[~going].astype("<u4")):
                        out[k] = ids.tobytes()
                    if not going.any():
                        break
                    rows, symbols, rank, at, best = rows[going], symbols[going], rank[going], at[going], best[going]
                line = np.arange(len(rows))
                symbols[line, at] = self.result[best]
                cols, spot = np.arange(width - 1, dtype=np.int32)[None], at[:, None].astype(np.int32)
                symbols = np.where(cols > spot, symbols[:, 1:], symbols[:, :-1])
                if width > 2:
                    rank = np.where(cols[:, :-1] >= spot, rank[:, 1:], rank[:, :-1])
                    left, right = at > 0, at < width - 2
                    rank[line[left], at[left] - 1] = self.rank(symbols[line[left], at[left] - 1], symbols[line[left], at[left]])
                    rank[line[right], at[right]] = self.rank(symbols[line[right], at[right]], symbols[line[right], at[right] + 1])
        return out


def _safe_split(safe: re.Pattern, split: str) -> re.Pattern:
    """The split rule for safe characters, spelled out for the faster standard engine."""
    chars = [chr(c) for c in range(0x2100) if safe.fullmatch(chr(c))]
    letters = "".join(regex.findall("\\p{L}", "".join(chars)))
    numbers = "".join(regex.findall("\\p{N}", "".join(chars)))
    rule = split.replace("[\\p{L}]", f"[{letters}]").replace("[\\p{N}]", f"[{numbers}]").replace("[^\\s\\p{L}\\p{N}]", f"[^\\s{letters}{numbers}]")
    return re.compile(rule)


class Encoder:
    """Token ids of whole texts as little-endian unsigned 32-bit bytes.

    For texts of plain Latin characters the file's rules (lower case, split, merges) are followed here, each distinct
    word being merged once and remembered, up to CACHE_WORDS; any other text, and any other kind of tokenizer, goes to the tokenizer itself."""

    SAFE = re.compile("[\t\n\r\x0b\x0c\x20-\x7e\xa0-\u012f\u0131-\u024f\u2013\u2014\u2018\u2019\u201c\u201d\u2026\u20ac]*")
    SPLIT = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        if path not in _TOKENIZERS:
            with open(path, encoding="utf-8") as file:
                rules = json.load(file)
            pre = (rules.get("pre_tokenizer") or {}).get("pretokenizers") or [{}]
            norms = [n.get("type") for n in (rules.get("normalizer") or {}).get("normalizers") or []]
            known = norms == ["NFC", "Replace", "Lowercase"] and pre[0].get("pattern") == {"Regex": self.SPLIT} and rules["model"]["type"] == "BPE" and not rules["model"].get("ignore_merges")
            specials = [t["content"] for t in rules.get("added_tokens") or []]
            _TOKENIZERS[path] = Tokenizer.from_file(path), WordBpe(rules["model"]) if known else None, specials
        self.tokenizer, self.bpe, self.specials = _TOKENIZERS[path]
        self.split = _safe_split(self.SAFE, self.SPLIT)
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def _plain(self, text: str) -> bool:
        return self.bpe is not None and self.SAFE.fullmatch(text) is not None and not any(s in text for s in self.specials)

    def _merge(self, chunks: list[str]) -> list[bytes]:
        """Ids of blank-free chunks that aren't remembered."""
        parts = [self.split.findall(c) for c in chunks]
        distinct = list(set().union(*parts))
        ids = dict(zip(distinct, self.bpe.encode([w.encode() for w in distinct])))
        return [ids[p[0]] if len(p) == 1 else b"".join([ids[w] for w in p]) for p in parts]

    def batch(self, texts: list[str | None]) -> list[bytes]:
        end = np.asarray([END_ID], "<u4").tobytes()
        chunks: list[list[str] | None] = [t.lower().split() if t and self._plain(t) else None for t in texts]
        if len(self.known) > CACHE_WORDS:
            self.older, self.known = self.known, {}
        known, older = self.known, self.older
        fresh = set().union(*[c for c in chunks if c]).difference(known)
        again = fresh.intersection(older)
        known.update((w, older[w]) for w in again)
        fresh = list(fresh - again)
        long: dict[str, bytes] = {}
        for w, ids in zip(fresh, self._merge(fresh)):
            (known if len(w) <= 40 else long)[w] = ids
        out = []
        for text, own in zip(texts, chunks):
            if own:
                found = [known[w] if w in known else long[w] for w in own] if long else map(known.__getitem__, own)
                out.append(b"".join(found) + end)
            elif text:
                ids = self.tokenizer.encode(text, add_special_tokens=False).ids
                out.append(np.asarray(ids, "<u4").tobytes() + end)
            else:
                out.append(end)
        return out


def pieces(docs: DataFrame, tokenizer_path: str, *, capacity: int = CAPACITY) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32."""
    small_batches(docs.sparkSession, 2000)

    def run(batches):
        encoder = Encoder(tokenizer_path)
        for b in batches:
            rows = []
            for doc_id, ids in zip(b.column("doc_id").to_pylist(), encoder.batch(b.column("text").to_pylist())):
                for n, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at : at + 4 * capacity]
                    rows.append((doc_id, n, at // 4, len(part) // 4, zlib.crc32(part)))
            cols = list(zip(*rows)) if rows else [[]] * 5
            types = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.record_batch([pa.array(c, t) for c, t in zip(cols, types)], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long")


def best_fit(sizes: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray, list[int]]:
    """Best-fit decreasing: bin and offset of each item, and how full each bin is.

    Bins are kept by the room they have left; one long integer marks which amounts of room exist."""
    order = np.argsort(-sizes, kind="stable")
    where, offset = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
    used: list[int] = []
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    marks = 0
    for i in order.tolist():
        size = int(sizes[i])
        fitting = marks >> size
        if fitting:
            room = size + (fitting & -fitting).bit_length() - 1
            k = by_room[room].pop()
            if not by_room[room]:
                marks &= ~(1 << room)
        else:
            k, room = len(used), capacity
            used.append(0)
        where[i], offset[i] = k, used[k]
        used[k] += size
        left = room - size
        if left:
            by_room[left].append(k)
            marks |= 1 << left
    return where, offset, used


def _pack_task(task: int, round_no: int, sizes: np.ndarray, capacity: int):
    where, offset, used = best_fit(sizes, capacity)
    base = (round_no << 58) | (task << 26)  # distinct over rounds and tasks
    return where + base, offset, used


def carried(used: list[int], nearly_full: int, each: int) -> np.ndarray:
    """Which bins of a task go up the tree: underfull ones, at most `each` of every fill.

    Best fit leaves at most one bin of a task half full or less, as two would have been joined.  So a merge has no more
    bins to place in others than it has children, and can't use more than that of any one fill: the bins beyond
    `each` would have come out of all merges as they are."""
    u = np.asarray(used, np.int64)
    order = np.argsort(u, kind="stable")
    ordered = u[order]
    number = np.empty(len(u), np.int64)
    number[order] = np.arange(len(u)) - np.searchsorted(ordered, ordered)
    return (u < nearly_full) & (number < each)


def _merger(round_no: int, capacity: int, nearly_full: int, each: int):
    def merge(key, frame):
        t = frame.sort_by([("used", "descending"), ("bin", "ascending")])
        task = key[0].as_py()
        where, offset, used = _pack_task(task, round_no, t.column("used").to_numpy(), capacity)
        own = where & ((1 << 26) - 1)
        return pa.table({"bin": t.column("bin"), "parent": pa.array(where), "shift": pa.array(offset), "fill": pa.array(np.asarray(used, np.int64)[own]), "up": pa.array(carried(used, nearly_full, each)[own] & (offset == 0)), "task": pa.array(np.full(len(where), task, np.int64))})

    return merge


def pack(items: DataFrame, *, capacity: int = CAPACITY, nearly_full: int = NEARLY_FULL, fan_in: int = FAN_IN) -> DataFrame:
    """items (with a column length, at most capacity) plus sequence_id and offset."""
    from pyspark import TaskContext

    names, each = [f.name for f in items.schema], LEVELS * fan_in

    def first(batches):
        got = [b for b in batches if b.num_rows]
        if not got:
            return
        t = pa.Table.from_batches(got)
        where, offset, used = _pack_task(TaskContext.get().partitionId(), 0, t.column("length").to_numpy(), capacity)
        own = where & ((1 << 26) - 1)
        up = carried(used, nearly_full, each)[own] & (offset == 0)
        yield from t.append_column("_bin", pa.array(where)).append_column("_at", pa.array(offset)).append_column("_fill", pa.array(np.asarray(used, np.int64)[own])).append_column("_up", pa.array(up)).to_batches()

    schema = widened(items.schema, _bin=T.LongType(), _at=T.LongType(), _fill=T.LongType(), _up=T.BooleanType())
    placed = written(items.mapInArrow(first, schema), "packed")
    # a bin's first item stands for it
    level = placed.where("_up").select(F.col("_bin").alias("bin"), F.col("_fill").alias("used"), (F.shiftright("_bin", 26).bitwiseAND((1 << 32) - 1)).alias("task"))
    tasks = (level.agg(F.max("task")).first()[0] or 0) + 1
    moves, round_no = [], 0
    while tasks > 1:
        round_no += 1
        tasks = -(-tasks // fan_in)

        grouped = level.select("bin", "used", F.floor(F.col("task") / fan_in).alias("task")).groupBy("task")
        moved = written(grouped.applyInArrow(_merger(round_no, capacity, nearly_full, each), "bin long, parent long, shift long, fill long, up boolean, task long"), f"merge{round_no}")
        moves.append(moved)
        level = moved.where("up").select(F.col("parent").alias("bin"), F.col("fill").alias("used"), "task")
    # places along the tree, from the top down
    total = None
    for moved in reversed(moves):
        step = moved.select("bin", "parent", "shift")
        if total is not None:
            up = total.select(F.col("bin").alias("parent"), F.col("root"), F.col("by"))
            step = step.join(up, "parent", "left")
            step = step.select("bin", F.coalesce("root", "parent").alias("root"), (F.col("shift") + F.coalesce("by", F.lit(0))).alias("by"))
        else:
            step = step.select("bin", F.col("parent").alias("root"), F.col("shift").alias("by"))
        total = step if total is None else step.unionByName(total)
    if total is None:
        return placed.select(*names, F.col("_bin").alias("sequence_id"), F.col("_at").alias("offset"))
    out = placed.join(total.withColumnRenamed("bin", "_bin"), "_bin", "left")
    return out.select(*names, F.coalesce("root", "_bin").alias("sequence_id"), (F.col("_at") + F.coalesce("by", F.lit(0))).alias("offset"))


def pack_documents(docs: DataFrame, tokenizer_path: str | None = None, **how) -> DataFrame:
    if tokenizer_path is None:
        import public_tokenizers

        tokenizer_path = public_tokenizers.path("word_bpe_49k.json")
    return pack(pieces(docs, tokenizer_path), **how)


def op7(docs: DataFrame) -> DataFrame:
    return pack_documents(docs)
