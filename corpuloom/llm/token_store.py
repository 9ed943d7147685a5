"""Token-id output as Re-Pair compressed shards.

Texts are ordered by doc_id, encoded with the tokenizers library, and each shard's id
sequence is compressed by a grammar: again and again, the frequent pairs of neighbouring
symbols are replaced by nonterminals, until no pair repeats. A shard stores its rules, the length that each
symbol expands to, the final sequence and the documents' places, so any range of ids can
be decoded alone. Shards are rows of a Parquet table, written and read by Spark, so the
format works on every file system that Spark can reach and survives lost executors.
"""

from __future__ import annotations

import json
import zlib
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpuloom.llm.common import SLICE_BYTES, slices
from corpuloom.session import scratch_path, ship, table

DEFAULT_TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
#: Appended to each document.
END_ID = 2
#: Ids in a shard, but that a document is never split.
SHARD_IDS = 1_500_000
#: A pair is replaced if it occurs so often in the shard; 2 goes on until no pair repeats.
LEAST = 2
#: Passes of Re-Pair over less than this fraction of the symbols link them instead of closing gaps.
LINKED = 8
SHARD_SCHEMA = (
    "part int, shard int, n_docs int, n_ids long, base int, doc_ids array<long>, doc_tokens binary, doc_symbols binary, rules binary, lengths binary, symbols binary"
)

# --- encoding with the library -----------------------------------------------------------

#: Classes of characters in the byte-level pattern.
_LETTER, _NUMBER, _SPACE, _OTHER = range(4)
#: The class of each ASCII character.
_CLASS = np.array([_LETTER if chr(c).isalpha() else _NUMBER if chr(c).isdigit() else _SPACE if chr(c) in " \t\n\x0b\x0c\r" else _OTHER for c in range(128)] + [_OTHER] * 128, np.uint8)
#: Bytes with which an uncommon character may start: separators U+001C to U+001F, U+0080 to U+00BF, U+0250 and above; and the start of a special token's string.
_SUSPECT = np.zeros(256, bool)
_SUSPECT[[*range(0x1C, 0x20), 0xC2, *range(0xC9, 0x100), ord("<")]] = True
#: Second bytes of U+0080 to U+00BF: controls and spaces, numerals, and letters.
_RARE, _LETTERS_C2 = np.zeros((2, 256), bool)
_RARE[[*range(0x80, 0xA1), 0xB2, 0xB3, 0xB9, 0xBC, 0xBD, 0xBE]] = True
_LETTERS_C2[[0xAA, 0xB5, 0xBA]] = True


def unsure_places(data: np.ndarray) -> np.ndarray:
    """Where in UTF-8 bytes an uncommon character or the start of a special token's string stands; the others are classed by piece_starts."""
    at = np.flatnonzero(_SUSPECT[data])
    head, then = data[at], data[np.minimum(at + 1, len(data) - 1)]
    common = ((head == 0xC2) & ~_RARE[then]) | ((head == 0xC9) & (then < 0x90)) | ((head == ord("<")) & (then != ord("|")))
    return at[~common]


def piece_starts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Marks where the byte-level pattern begins a piece: runs of letters, of numbers, of other characters, each with one space before; contractions; white space.

    data: UTF-8 bytes of texts without uncommon characters, from offsets[i] to offsets[i + 1].
    """
    kind = _CLASS[data]
    lead = np.flatnonzero(data >= 0xC2)
    if len(lead):
        head, then = data[lead], data[np.minimum(lead + 1, len(data) - 1)]
        times = (head == 0xC3) & ((then == 0x97) | (then == 0xB7))
        kind[lead] = np.where(times | ((head == 0xC2) & ~_LETTERS_C2[then]), _OTHER, _LETTER)
        kind[np.minimum(lead + 1, len(data) - 1)] = kind[lead]
    begin = offsets[:-1][offsets[:-1] < len(data)]
    start = np.empty(len(data), bool)
    start[1:] = kind[1:] != kind[:-1]
    start[begin] = True
    after = np.flatnonzero(start & (kind != _SPACE))
    after = after[(after > 0) & ~np.isin(after, begin)]
    spaced = after[kind[after - 1] == _SPACE]
    # The last white space before a run is apart from those before it, and joins the run if it is a space.
    start[spaced - 1] = True
    start[spaced[data[spaced - 1] == 0x20]] = False
    quote = np.flatnonzero((data[:-1] == ord("'")) & start[:-1])
    if len(quote):
        ends = offsets[np.searchsorted(offsets, quote, side="right")]
        x, y = data[quote + 1], data[np.minimum(quote + 2, len(data) - 1)]
        one, two = np.isin(x, list(b"stmd")), (np.isin(x, list(b"rv")) & (y == ord("e"))) | ((x == ord("l")) & (y == ord("l")))
        size = np.where(one & (quote + 1 < ends), 2, np.where(two & (quote + 2 < ends), 3, 0))
        quote, size = quote[size > 0], size[size > 0]
        start[quote + 1] = False
        rest = (quote + size)[quote + size < len(data)]
        start[rest] = True
        # A space that follows was a start, and a letter after the contraction is one now; continuation bytes are none.
    return start


def byte_level(tok) -> bool:
    """Whether a tokenizer cuts by the byte-level pattern and changes no text before: then a text may be encoded in parts."""
    try:
        pre = json.loads(tok.pre_tokenizer.__getstate__())
    except (AttributeError, TypeError, ValueError):
        return False
    return tok.normalizer is None and pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True)


class LibraryEncoder:
    """The tokenizers library, remembering the ids of pieces that it has encoded.

    The library encodes the pieces of its pre-tokenisation independently, so a text's ids are its pieces' ids
    in a row. The distinct pieces of a batch are looked up once, and the library gets new ones. Texts with
    uncommon characters, and all texts of a tokenizer with another pre-tokenisation, go to the library whole.
    The memo has two generations of bounded size; pieces that are met again move to the new one.
    """

    def __init__(self, path: str, memo: int = 300_000):
        from tokenizers import Tokenizer

        self.tok, self.bound, self.memo, self.old = Tokenizer.from_file(path), memo, {}, {}
        self.parted = byte_level(self.tok)
        vocabulary = self.tok.get_vocab()
        #: Bytes of each token; in a byte-level vocabulary a character stands for a byte.
        self.token_size = np.zeros(max(vocabulary.values()) + 1, np.int64)
        for token, i in vocabulary.items():
            self.token_size[i] = len(token)

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts (strings without nulls) in a row, and how many each has."""
        n = len(texts)
        offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + n + 1].astype(np.int64) if n else np.zeros(1, np.int64)
        data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
        offsets = offsets - offsets[0]
        if not self.parted or not len(data):
            ids = [np.array(e.ids, np.uint32) for e in self.tok.encode_batch_fast(texts.to_pylist(), add_special_tokens=False)]
            return np.concatenate([*ids, np.empty(0, np.uint32)]), np.array(list(map(len, ids)), np.int64)
        start = piece_starts(data, offsets)
        whole = np.unique(np.searchsorted(offsets, unsure_places(data), side="right") - 1)
        for d in whole.tolist():
            start[offsets[d] + 1 : offsets[d + 1]] = False
        edges = np.append(np.flatnonzero(start), len(data))
        pieces = pa.BinaryArray.from_buffers(pa.binary(), len(edges) - 1, [None, pa.py_buffer(edges.astype(np.int32)), pa.py_buffer(data)])
        lone = np.searchsorted(edges, offsets[whole])
        found = pieces.dictionary_encode()
        # By way of numpy: to_pylist() makes a scalar of each piece.
        distinct = found.dictionary.to_numpy(zero_copy_only=False).tolist()
        values = pa.array(self._values(distinct, set(found.indices.to_numpy()[lone].tolist())), pa.binary())
        out = values.take(found.indices)
        ends = np.frombuffer(out.buffers()[1], np.int32)[: len(edges)] // 4
        ids = np.frombuffer(out.buffers()[2], np.uint32)[: ends[-1]]
        return ids, np.diff(ends[np.searchsorted(edges, offsets)]).astype(np.int64)

    def _values(self, pieces: list[bytes], whole: set[int]) -> list[bytes]:
        """The ids of distinct pieces as little-endian unsigned 32-bit integers; those at the places `whole` are texts."""
        if len(self.memo) > self.bound:
            self.old, self.memo = self.memo, {}
        values = list(map(self.memo.get, pieces))
        missing = [i for i, v in enumerate(values) if v is None]
        if self.old:
            again = [(i, v) for i, v in zip(missing, map(self.old.get, [pieces[i] for i in missing]), strict=True) if v is not None]
            for i, v in again:
                values[i] = self.memo[pieces[i]] = v
            missing = [i for i in missing if values[i] is None]
        # Pieces led by a space part by themselves in a row, so many are encoded as one text.
        spaces = (b" ", b"\t", b"\n", b"\x0b", b"\x0c", b"\r")
        led = [i for i in missing if pieces[i][:1] == b" " and len(pieces[i]) > 1 and pieces[i][1:2] not in spaces and i not in whole]
        rest = sorted({*missing}.difference(led))
        for k in range(0, len(led), 10_000):
            part = [pieces[i] for i in led[k : k + 10_000]]
            # Tokens never span pieces, so their lengths in bytes tell where each piece ends.
            ids = np.array(self.tok.encode_batch_fast([b"".join(part).decode()], add_special_tokens=False)[0].ids, np.uint32)
            ends = np.cumsum(self.token_size[ids])
            piece_ends = np.cumsum(np.fromiter(map(len, part), np.int64, len(part)))
            cuts = np.searchsorted(ends, piece_ends) + 1
            if ends[-1] != piece_ends[-1] or (ends[cuts - 1] != piece_ends).any():
                rest += led[k : k + 10_000]
                continue
            raw, cuts = ids.tobytes(), (4 * cuts).tolist()
            own = [raw[a:b] for a, b in zip([0, *cuts], cuts, strict=False)]
            self.memo.update(zip(part, own, strict=True))
            for i, v in zip(led[k : k + 10_000], own, strict=True):
                values[i] = v
        for i, e in zip(rest, self.tok.encode_batch_fast([pieces[i].decode("utf-8", "surrogatepass") for i in rest], add_special_tokens=False), strict=True):
            values[i] = np.array(e.ids, np.uint32).tobytes()
            if i not in whole:
                self.memo[pieces[i]] = values[i]
        return values


@lru_cache(maxsize=1)
def _library(path: str) -> LibraryEncoder:
    return LibraryEncoder(path)


# --- the grammar -------------------------------------------------------------------------


def repair(ids: np.ndarray, last: np.ndarray, base: int, least: int = LEAST) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Compress ids; returns rules (pairs of symbols, the first is symbol `base`), the sequence, and which of its symbols end a document.

    last: which ids end a document; no pair spans two documents. A pass counts pairs over the whole
    shard and replaces a pair at each place where it is more frequent than the pairs that overlap it; passes go on
    until no pair occurs `least` times without overlap. A pair of old symbols that is rare once stays rare, so
    later passes look only at places of frequent pairs and at neighbours of replaced ones. While these are many,
    each pass closes the gaps it made, so neighbours stand side by side; once they are few, symbols are linked to
    the next and the previous one, and those that are gone are left out at the end.
    """
    seq, last, n = ids.astype(np.uint32), last.copy(), len(ids)
    linked = False
    rules = [np.empty((0, 2), np.uint32)]
    named = base
    live = np.flatnonzero(~last[:-1]).astype(np.int32)
    while len(live):
        if not linked and len(live) < n // LINKED:
            linked = True
            after, before = np.arange(1, n + 1, dtype=np.int32), np.arange(-1, n - 1, dtype=np.int32)
            gone, mark = np.zeros(n, bool), np.zeros(n, bool)
            # How strongly a place competes; the last one stands for no place.
            weight = np.zeros(n + 1, np.int32)
        at, pair, bits = _sorted_pairs(seq, live, np.take(after, live) if linked else live + 1, named, n)
        starts = np.flatnonzero(np.concatenate([[True], pair[1:] != pair[:-1]]))
        many = np.diff(starts, append=len(pair))
        often = many >= least
        heads, counts = pair[starts[often]], many[often]
        if not len(counts):
            break
        at = at[np.repeat(often, many)]
        first, second = (heads >> np.uint64(bits)).astype(np.uint32), (heads & np.uint64((1 << bits) - 1)).astype(np.uint32)
        # Where each pair's places begin, and how many of them count.
        begins, apart = np.cumsum(counts) - counts, counts
        follow, odd = np.take(after, at) if linked else at + 1, np.empty(0, np.int64)
        same = first == second
        if same.any():
            # In a run of one symbol every second place counts and competes, from the left.
            twins, own = np.flatnonzero(np.repeat(same, counts)), counts[same]
            p, pair_of = at[twins], np.repeat(np.arange(len(own)), own)
            run = np.flatnonzero(np.concatenate([[True], (follow[twins[:-1]] != p[1:]) | (np.diff(pair_of) != 0)]))
            is_odd = (np.arange(len(p)) - np.repeat(run, np.diff(run, append=len(p)))) % 2 == 1
            odd, apart = twins[is_odd], counts.copy()
            apart[same] -= np.bincount(pair_of[is_odd], minlength=len(own))
        by = np.sort((apart.astype(np.uint64) << np.uint64(32)) | np.arange(len(counts), dtype=np.uint64))
        rank = np.empty(len(counts), np.int32)
        rank[(by & np.uint64(0xFFFFFFFF)).astype(np.int64)] = np.arange(1, len(counts) + 1)
        rank[apart < least] = 0
        own = np.repeat(rank, counts)
        own[odd] = 0
        if linked:
            weight[at] = own
            chosen = own > np.take(weight, np.take(before, at))
            chosen &= own > np.take(weight, follow)
            weight[at] = 0
        else:
            weight = np.zeros(n + 2, np.int32)
            weight[at + 1] = own
            strongest = weight[1:-1] > weight[:-2]
            strongest &= weight[1:-1] > weight[2:]
            chosen = np.take(strongest, at)
        hits = np.add.reduceat(chosen, begins, dtype=np.int32)
        good = hits >= least
        if not good.any():
            # The most frequent pair wins at all of its places, so now none is frequent.
            break
        chosen &= np.repeat(good, counts)
        where, second_at = at[chosen], follow[chosen]
        seq[where] = np.repeat(np.arange(named, named + int(good.sum()), dtype=np.uint32), hits[good])
        last[where] = last[second_at]
        rules.append(np.stack([first[good], second[good]], axis=1))
        named += len(rules[-1])
        if not linked:
            near, new, stay = np.zeros(n, bool), np.zeros(n, bool), np.ones(n, bool)
            near[at], new[where], stay[second_at] = True, True, False
            seq, last, near, new = seq[stay], last[stay], near[stay], new[stay]
            near |= new
            near[:-1] |= new[1:]
            near &= ~last
            n, live = len(seq), np.flatnonzero(near).astype(np.int32)
            continue
        gone[second_at] = True
        beyond = after[second_at]
        after[where] = beyond
        before[beyond[beyond < n]] = where[beyond < n]
        mark[at] = True
        mark[second_at] = False
        left = before[where]
        mark[left[left >= 0]] = True
        mark[where] = True
        live = np.flatnonzero(mark).astype(np.int32)
        mark[live] = False
        live = live[~last[live]]
    if linked:
        seq, last = seq[~gone], last[~gone]
    return np.concatenate(rules), seq, last


def _sorted_pairs(seq: np.ndarray, live: np.ndarray, follow: np.ndarray, named: int, n: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Places and pairs at `live` places by pair, then place, and the bits of a symbol in a pair."""
    bits, place = int(named).bit_length(), int(n).bit_length()
    both = np.take(seq, live).astype(np.uint64)
    if 2 * bits + place > 64:
        both <<= np.uint64(32)
        both |= np.take(seq, follow)
        order = np.argsort(both, kind="stable")
        return live[order], both[order], 32
    both <<= np.uint64(bits)
    both |= np.take(seq, follow)
    both <<= np.uint64(place)
    both |= live.view(np.uint32)
    both.sort()
    at = both.astype(np.uint32)
    at &= np.uint32((1 << place) - 1)
    both >>= np.uint64(place)
    return at.view(np.int32), both, bits


def _levels(rules: np.ndarray, base: int):
    """Ranges of rules, each of which uses only ids and rules of earlier ranges."""
    newest = rules.max(axis=1).astype(np.int64) - base
    lo = 0
    while lo < len(rules):
        later = newest[lo:] >= lo
        hi = lo + int(later.argmax()) if later.any() else len(rules)
        yield lo, hi
        lo = hi


def lengths_of(rules: np.ndarray, base: int) -> np.ndarray:
    """Ids that each symbol from `base` expands to; a rule uses only ids and earlier rules."""
    size = np.ones(base + len(rules), np.int64)
    for lo, hi in _levels(rules, base):
        size[base + lo : base + hi] = size[rules[lo:hi]].sum(axis=1)
    return size[base:]


def _spread(starts: np.ndarray, many: np.ndarray) -> np.ndarray:
    """The numbers start, start + 1, ... of ranges in a row."""
    before = np.cumsum(many) - many
    return np.repeat(starts - before, many) + np.arange(int(many.sum()))


def expand(symbols: np.ndarray, rules: np.ndarray, lengths: np.ndarray, base: int) -> np.ndarray:
    """The ids of a sequence of symbols, by way of all rules' ids."""
    size = np.concatenate([np.ones(base, np.int64), lengths])
    start = np.cumsum(size) - size
    flat = np.arange(int(size.sum()), dtype=np.uint32)
    for lo, hi in _levels(rules, base):
        left, right = rules[lo:hi, 0].astype(np.int64), rules[lo:hi, 1].astype(np.int64)
        to = start[base + lo : base + hi]
        flat[_spread(to, size[left])] = flat[_spread(start[left], size[left])]
        flat[_spread(to + size[left], size[right])] = flat[_spread(start[right], size[right])]
    symbols = symbols.astype(np.int64)
    return flat[_spread(start[symbols], size[symbols])]


def decode_range(shard: dict, doc: int, start: int = 0, stop: int | None = None) -> np.ndarray:
    """Ids [start, stop) of the doc-th document of a shard (a row as a dict), expanding only the symbols that cover them."""
    base = shard["base"]
    rules = np.frombuffer(shard["rules"], np.uint32).reshape(-1, 2)
    lengths = np.frombuffer(shard["lengths"], np.uint32)
    many = np.frombuffer(shard["doc_symbols"], np.uint32)
    first = int(many[:doc].sum())
    symbols = _symbols(shard)[first : first + int(many[doc])].astype(np.int64)
    at = 0
    while True:
        inner = symbols >= base
        size = np.ones(len(symbols), np.int64)
        size[inner] = lengths[symbols[inner] - base]
        ends = at + np.cumsum(size)
        if stop is None:
            stop = int(ends[-1]) if len(ends) else 0
        covers = (ends > start) & (ends - size < stop)
        at = int((ends - size)[covers][0]) if covers.any() else start
        symbols, inner = symbols[covers], inner[covers]
        if not inner.any():
            return symbols.astype(np.uint32)
        # Each nonterminal that is left gives way to its two symbols.
        pairs = np.stack([symbols, np.full(len(symbols), -1)], axis=1)
        pairs[inner] = rules[symbols[inner] - base]
        symbols = pairs[pairs >= 0]


def _symbols(shard: dict) -> np.ndarray:
    narrow = shard["base"] + len(shard["rules"]) // 8 <= 0x10000
    return np.frombuffer(shard["symbols"], np.uint16 if narrow else np.uint32)


def make_shard(part: int, shard: int, doc_ids: list, ids: np.ndarray, many: np.ndarray, base: int, **params) -> dict:
    """One row of the shard table from its documents' ids (with the end id) in a row, and how many each has."""
    last = np.zeros(len(ids), bool)
    last[np.cumsum(many) - 1] = True
    rules, seq, ends = repair(ids, last, base, **params)
    per_doc = np.diff(np.concatenate([[-1], np.flatnonzero(ends)])).astype(np.uint32)
    return {
        "part": part, "shard": shard, "n_docs": len(doc_ids), "n_ids": len(ids), "base": base, "doc_ids": doc_ids, "doc_tokens": many.astype(np.uint32).tobytes(),
        "doc_symbols": per_doc.tobytes(), "rules": rules.tobytes(), "lengths": lengths_of(rules, base).astype(np.uint32).tobytes(),
        "symbols": (seq.astype(np.uint16) if base + len(rules) <= 0x10000 else seq).tobytes(),
    }


# --- the distributed operator ------------------------------------------------------------


def write_tokens(docs: DataFrame, path: str, tokenizer: str = DEFAULT_TOKENIZER, end_id: int = END_ID, shard_ids: int = SHARD_IDS, partitions: int | None = None, **params) -> None:
    """Encode texts and write them in ascending doc_id order as shards at `path`.

    A null text is an empty document, which has only the end id. Null doc_ids come
    first. Documents are range partitioned by doc_id and sorted within a
    partition; the shards' numbers (part, shard) are in the order of the ids.
    """
    spark = docs.sparkSession
    ship(spark)
    schema = pa.schema([
        ("part", pa.int32()), ("shard", pa.int32()), ("n_docs", pa.int32()), ("n_ids", pa.int64()), ("base", pa.int32()), ("doc_ids", pa.list_(pa.int64())),
        *((k, pa.binary()) for k in ("doc_tokens", "doc_symbols", "rules", "lengths", "symbols")),
    ])

    def run(batches):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        encode = _library(tokenizer)
        base = max(encode.tok.get_vocab_size(), end_id + 1)
        part, shard, doc_ids, held, many = TaskContext.get().partitionId(), 0, [], [], []
        for whole in batches:
            for b in slices(whole, "text", 2 * SLICE_BYTES):
                ids, counts = encode(pc.fill_null(b.column("text"), ""))
                counts, docs_ = counts + 1, b.column("doc_id").to_pylist()
                ends = np.cumsum(counts)
                ended = np.full(len(ids) + len(counts), end_id, np.uint32)
                inner = np.ones(len(ended), bool)
                inner[ends - 1] = False
                ended[inner] = ids
                at = 0
                while at < len(counts):
                    # The document that fills the shard is its last.
                    to = min(len(counts), at + 1 + int(np.searchsorted(ends[at:] - (ends[at - 1] if at else 0), shard_ids - sum(map(len, held)))))
                    held.append(ended[ends[at] - counts[at] : ends[to - 1]])
                    many.append(counts[at:to])
                    doc_ids += docs_[at:to]
                    at = to
                    if sum(map(len, held)) >= shard_ids:
                        yield pa.RecordBatch.from_pylist([make_shard(part, shard, doc_ids, np.concatenate(held), np.concatenate(many), base, **params)], schema)
                        shard, doc_ids, held, many = shard + 1, [], [], []
        if doc_ids:
            yield pa.RecordBatch.from_pylist([make_shard(part, shard, doc_ids, np.concatenate(held), np.concatenate(many), base, **params)], schema)

    n = partitions or max(int(spark.conf.get("spark.sql.shuffle.partitions")), docs.rdd.getNumPartitions())
    # Rows of one doc_id go by their text's hash, so that a frequent id is spread too.
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("hash"), "text")
    ordered = keyed.repartitionByRange(n, "doc_id", "hash").sortWithinPartitions("doc_id", "hash")
    ordered.select("doc_id", "text").mapInArrow(run, SHARD_SCHEMA).write.parquet(path)


def shard_starts(shards: DataFrame) -> DataFrame:
    """part, shard, shard_start: ids of all shards before it. Sums within parts first, then over the parts' totals."""
    sizes = shards.select("part", "shard", "n_ids")
    parts = sizes.groupBy("part").agg(F.sum("n_ids").alias("total"))
    before = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    offsets = parts.select("part", F.coalesce(F.sum("total").over(before(Window.orderBy("part"))), F.lit(0)).alias("offset"))
    own = sizes.withColumn("inside", F.coalesce(F.sum("n_ids").over(before(Window.partitionBy("part").orderBy("shard"))), F.lit(0)))
    return own.join(offsets, "part").select("part", "shard", (F.col("offset") + F.col("inside")).alias("shard_start"))


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids_crc32 and the shard's place, decoded from the shards."""
    ship(spark)
    shards = spark.read.parquet(path)

    def run(batches):
        for b in batches:
            for row in b.to_pylist():
                ids = expand(_symbols(row), np.frombuffer(row["rules"], np.uint32).reshape(-1, 2), np.frombuffer(row["lengths"], np.uint32).astype(np.int64), row["base"])
                many = np.frombuffer(row["doc_tokens"], np.uint32).astype(np.int64)
                ends = np.cumsum(many)
                raw = memoryview(ids.astype("<u4").tobytes())
                crc = [zlib.crc32(raw[4 * (e - m) : 4 * e]) for e, m in zip(ends.tolist(), many.tolist(), strict=True)]
                n = len(many)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(row["doc_ids"], pa.int64()), pa.array([row["part"]] * n, pa.int32()), pa.array([row["shard"]] * n, pa.int32()), pa.array(ends - many), pa.array(many), pa.array(crc, pa.int64())],
                    ["doc_id", "part", "shard", "inside", "n_tokens", "ids_crc32"],
                )

    docs = shards.mapInArrow(run, "doc_id long, part int, shard int, inside long, n_tokens long, ids_crc32 long")
    return docs.join(shard_starts(shards), ["part", "shard"]).select("doc_id", (F.col("shard_start") + F.col("inside")).alias("start"), "n_tokens", "ids_crc32", "part", "shard")


def op5_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document, read back from the shards: ids before it, its number of ids with the end id, and their CRC-32."""
    path = scratch_path(spark, "tokens")
    write_tokens(table(spark, sf_dir, "documents"), path)
    return read_tokens(spark, path).select("doc_id", "start", "n_tokens", "ids_crc32")
