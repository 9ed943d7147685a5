"""BPE encoding and decoding with a minimal acyclic transducer lexicon.

Frequent words of the corpus (pieces of the tokenizer's pre-tokenisation), each with
its token ids, are compiled into a minimal acyclic automaton whose suffixes are shared.
Arc weights add up along a path to the word's number, which points at its ids. The
automaton is a few arrays in one folder that Spark ships to every executor, where
Python workers memory-map it; whole batches of words walk it together. Words that it
does not hold are merged exactly by the tokenizer's ranks.
"""

from __future__ import annotations

import hashlib
import json
import os
import tempfile
import uuid
import zipfile
from collections import Counter
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuloom.llm.common import slices
from corpuloom.session import ship, table

DEFAULT_TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
#: Most words in a lexicon.
LEXICON_WORDS = 131_072
#: Most distinct characters that the lexicon's words use; words with others are merged.
ALPHABET = 255
SPACE, LETTER, NUMBER, OTHER = 0, 1, 2, 3


@lru_cache(maxsize=1)
def byte_characters() -> dict[str, int]:
    """The character that stands for each byte in a byte-level vocabulary, by the published rule: printable bytes stand for themselves, the others follow from U+0100."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(0x100 + i): b for i, b in enumerate(rest)}


class Merger:
    """The vocabulary and exact merges of a byte-level BPE tokenizer file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        to_byte = byte_characters()
        vocab = spec["model"]["vocab"]
        as_bytes = lambda token: bytes(to_byte[c] for c in token)
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.size = max([*vocab.values(), *self.special.values()]) + 1
        self.token = [b""] * self.size
        for token, i in vocab.items():
            if token not in self.special:
                self.token[i] = as_bytes(token)
        for token, i in self.special.items():
            self.token[i] = token.encode()
        self.of_byte = [vocab[c] for c, _ in sorted(to_byte.items(), key=lambda x: x[1])]
        self.ranks = {}
        for rank, pair in enumerate(spec["model"]["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            self.ranks[vocab[a], vocab[b]] = (rank, vocab[a + b])

    def merge(self, word: bytes) -> list[int]:
        """Token ids of one pre-tokenised word: the pair of lowest rank is merged first, leftmost first."""
        ids = [self.of_byte[b] for b in word]
        if len(ids) > 64:
            return self._merge_long(ids)
        ranks = self.ranks
        while len(ids) > 1:
            best, at = None, -1
            for i in range(len(ids) - 1):
                found = ranks.get((ids[i], ids[i + 1]))
                if found is not None and (best is None or found[0] < best[0]):
                    best, at = found, i
            if best is None:
                break
            ids[at : at + 2] = [best[1]]
        return ids

    def _merge_long(self, ids: list[int]) -> list[int]:
        """The same for long words, with a heap over a linked list."""
        import heapq

        n, ranks = len(ids), self.ranks
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(*ranks[p], i, *p) for i in range(n - 1) if (p := (ids[i], ids[i + 1])) in ranks]
        heap = [(r, i, new, a, b) for r, new, i, a, b in heap]
        heapq.heapify(heap)
        while heap:
            _, i, new, a, b = heapq.heappop(heap)
            j = after[i] if ids[i] == a else n
            if j >= n or ids[j] != b:
                continue
            ids[i], ids[j], after[i] = new, -1, after[j]
            if after[j] < n:
                before[after[j]] = i
            for x in (before[i], i):
                if x >= 0 and after[x] < n and (p := (ids[x], ids[after[x]])) in ranks:
                    heapq.heappush(heap, (ranks[p][0], x, ranks[p][1], *p))
        return [x for x in ids if x >= 0]


def character_classes() -> np.ndarray:
    """Class of every code point, asked of the tokenizer library's own pattern engine."""
    from tokenizers import Regex, normalizers

    out = np.full(0x110000, OTHER, np.uint8)
    scalars = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    for name, kind in ((r"\p{L}", LETTER), (r"\p{N}", NUMBER), (r"\s", SPACE)):
        for at in range(0, len(scalars), 0x8000):
            part = scalars[at : at + 0x8000]
            # What the engine takes away belongs to the class.
            left = np.frombuffer(normalizers.Replace(Regex(name), "").normalize_str("".join(map(chr, part))).encode("utf-32-le"), np.uint32)
            gone = np.array(part, np.uint32)
            out[gone[~np.isin(gone, left)]] = kind
    return out


def split_words(cps: np.ndarray, first: np.ndarray, classes: np.ndarray) -> np.ndarray:
    """Where the words of concatenated texts start, by the tokenizer's pattern.

    first: where texts start (sorted, without empty texts). The pattern takes English
    contractions, then runs of letters, of numbers or of others with a space before
    them, then white space; the last white space before other text stands alone or,
    if it is a space, leads the next word.
    """
    n = len(cps)
    if not n:
        return np.empty(0, np.int64)
    kind = classes[cps]
    opens = np.zeros(n + 1, bool)
    opens[first] = True
    opens[n] = True
    space = kind == SPACE
    blank = cps == 32
    prev_space = np.concatenate([[False], space[:-1]]) & ~opens[:n]
    prev_blank = np.concatenate([[False], blank[:-1]]) & ~opens[:n]
    prev_kind = np.concatenate([[255], kind[:-1]])
    next_solid = np.concatenate([~space[1:], [False]]) & ~opens[1:]
    start = opens[:n].copy()
    start |= ~space & ((prev_kind != kind) & ~prev_blank)
    # A run of white space starts a word; so does its last character before other text.
    start |= space & (~prev_space | next_solid)
    apostrophes = np.flatnonzero((cps == 39) & start)
    if len(apostrophes):
        ends = np.flatnonzero(opens)
        room = ends[np.searchsorted(ends, apostrophes, side="right")] - apostrophes
        at = lambda k: cps[np.minimum(apostrophes + k, n - 1)] * (room > k)
        one, two = at(1), at(2)
        short = np.isin(one, [ord(c) for c in "stmd"])
        long = ((one == ord("r")) & (two == ord("e"))) | ((one == ord("v")) & (two == ord("e"))) | ((one == ord("l")) & (two == ord("l")))
        for where, size in ((apostrophes[short], 2), (apostrophes[long], 3)):
            for k in range(1, size):
                start[where + k] = False
            after = where + size
            after = after[after < n]
            solid = after[~space[after]]
            start[solid] = True
    return np.flatnonzero(start)


# --- the automaton ---------------------------------------------------------------------------


def compile_automaton(words: list[bytes]) -> dict[str, np.ndarray]:
    """The minimal acyclic automaton of sorted distinct code sequences, as arrays.

    An arc of state s under code c is slot base[s] + c if owner[slot] == s; it leads to
    target[slot], and the weights along a word's path add up to the word's place in `words`.
    """
    register: dict = {}
    arcs: list[list] = [[]]
    final = [False]
    free: list[int] = []
    path: list[int] = [0]

    def settle(depth: int) -> None:
        """Replace the states below `depth` on the open path by equal registered ones."""
        for d in range(len(path) - 1, depth, -1):
            state, parent = path[d], path[d - 1]
            key = (final[state], tuple(arcs[state]))
            known = register.get(key)
            if known is None:
                register[key] = state
            else:
                code, _ = arcs[parent][-1]
                arcs[parent][-1] = (code, known)
                arcs[state] = []
                final[state] = False
                free.append(state)
        del path[depth + 1 :]

    last = b""
    for word in words:
        common = 0
        for x, y in zip(last, word, strict=False):
            if x != y:
                break
            common += 1
        settle(common)
        for code in word[common:]:
            if free:
                state = free.pop()
            else:
                state = len(arcs)
                arcs.append([])
                final.append(False)
            arcs[path[-1]].append((code, state))
            path.append(state)
        final[path[-1]] = True
        last = word
    settle(0)

    counts = [-1] * len(arcs)
    stack = [0]
    while stack:
        s = stack[-1]
        if counts[s] >= 0:
            stack.pop()
            continue
        todo = [t for _, t in arcs[s] if counts[t] < 0]
        if todo:
            stack += todo
        else:
            counts[s] = final[s] + sum(counts[t] for _, t in arcs[s])
            stack.pop()
    used = [s for s in range(len(arcs)) if counts[s] >= 0]
    number = {s: i for i, s in enumerate(used)}
    total = sum(len(arcs[s]) for s in used)
    room = total * 2 + 1024
    owner = np.full(room, -1, np.int32)
    target = np.zeros(room, np.int32)
    weight = np.zeros(room, np.int32)
    base = np.zeros(len(used), np.int32)
    taken = bytearray(room)
    lowest, high = 256, 256
    for s in sorted(used, key=lambda x: -len(arcs[x])):
        if not arcs[s]:
            continue
        codes = [c for c, _ in arcs[s]]
        slot, tries = lowest, 0
        while True:
            # After some failed places the state goes behind all others, so that placing stays linear.
            slot = taken.find(0, slot) if tries < 48 else max(slot, high)
            if slot < 0 or slot + 512 >= room:
                owner, target, weight = (np.concatenate([x, np.full(room, fill, np.int32)]) for x, fill in ((owner, -1), (target, 0), (weight, 0)))
                taken += bytearray(room)
                room *= 2
                slot = max(slot, lowest)
                continue
            b = slot - codes[0]
            if not any(taken[b + c] for c in codes[1:]):
                break
            slot, tries = slot + 1, tries + 1
        if tries >= 48:
            lowest = max(lowest, min(slot, lowest + 16))
        high = max(high, b + codes[-1] + 1)
        base[number[s]] = b
        before = int(final[s])
        for c, t in arcs[s]:
            taken[b + c] = 1
            owner[b + c], target[b + c], weight[b + c] = number[s], number[t], before
            before += counts[t]
    owner, target, weight = (x[: high + 512] for x in (owner, target, weight))
    return {"base": base, "owner": owner, "target": target, "weight": weight, "final": np.array([final[s] for s in used], bool)}


def build_lexicon(words: list[str], merger: Merger) -> dict[str, np.ndarray]:
    """Automaton, alphabet and ids of the words; a word with a character outside the alphabet is left out."""
    seen = Counter()
    for w in words:
        seen.update(set(w))
    letters = sorted(c for c, _ in sorted(seen.items(), key=lambda x: (-x[1], x[0]))[: ALPHABET - 1])
    code = {c: i + 1 for i, c in enumerate(letters)}
    coded = sorted({bytes(code[c] for c in w): w for w in words if w and all(c in code for c in w)}.items())
    ids = [merger.merge(w.encode("utf-8")) for _, w in coded]
    alphabet = np.zeros(0x110000, np.uint8)
    for c, i in code.items():
        alphabet[ord(c)] = i
    out = compile_automaton([k for k, _ in coded])
    out["alphabet"] = alphabet
    out["offsets"] = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32)
    out["ids"] = np.array([i for x in ids for i in x], np.int32)
    out["longest"] = np.array([max([0, *(len(k) for k, _ in coded)])], np.int32)
    return out


class Encoder:
    """Encodes batches of texts with a lexicon's arrays; unseen words are merged and remembered up to a bound."""

    def __init__(self, merger: Merger, lexicon: dict[str, np.ndarray], classes: np.ndarray, memo: int = 150_000):
        self.m, self.x, self.classes, self.bound = merger, lexicon, classes, memo
        self.memo: dict[str, list[int]] = {}
        self.n_words = len(lexicon["offsets"]) - 1
        self.token_bytes = np.frombuffer(b"".join(merger.token), np.uint8)
        self.token_size = np.array([len(t) for t in merger.token], np.int64)
        self.token_at = np.cumsum(self.token_size) - self.token_size
        self.special = sorted(merger.special, key=len, reverse=True)

    def numbers(self, cps: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The lexicon's number of each word, -1 for an unseen one."""
        x, sizes = self.x, ends - starts
        out = np.full(len(starts), -1, np.int64)
        order = np.argsort(-np.minimum(sizes, 32767).astype(np.int16), kind="stable")
        order = order[sizes[order] <= x["longest"][0]]
        codes = x["alphabet"][cps]
        at, left = starts[order], sizes[order]
        state, value = np.zeros(len(order), np.int32), np.zeros(len(order), np.int32)
        base, owner, target, weight, final = (x[k] for k in ("base", "owner", "target", "weight", "final"))
        step = 0
        while len(order):
            alive = np.searchsorted(-left, -step, side="left")  # words with more than `step` characters come first
            done = slice(alive, None)
            hit = final[state[done]]
            out[order[done][hit]] = value[done][hit]
            order, at, left, state, value = order[:alive], at[:alive], left[:alive], state[:alive], value[:alive]
            if not alive:
                break
            c = codes[at + step]
            slot = base[state] + c
            ok = (owner[slot] == state) & (c > 0)
            if not ok.all():
                order, at, left, slot, value = order[ok], at[ok], left[ok], slot[ok], value[ok]
            value = value + weight[slot]
            state = target[slot]
            step += 1
        return out

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, concatenated, and how many each text has."""
        if any(s in t for s in self.special for t in texts):
            return self._with_special(texts)
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        joined = "".join(texts)
        cps = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
        text_at = np.cumsum(sizes) - sizes
        starts = split_words(cps, text_at[sizes > 0], self.classes)
        ends = np.append(starts[1:], len(cps))
        number = self.numbers(cps, starts, ends)
        offsets, ids = self.x["offsets"], self.x["ids"]
        misses = np.flatnonzero(number < 0)
        if len(misses):
            local: dict[str, int] = {}
            extra: list[list[int]] = []
            memo = self.memo
            to = []
            for i, j in zip(starts[misses].tolist(), ends[misses].tolist(), strict=True):
                w = joined[i:j]
                k = local.get(w)
                if k is None:
                    found = memo.get(w)
                    if found is None:
                        if len(memo) >= self.bound:
                            memo.clear()
                        found = memo[w] = self.m.merge(w.encode("utf-8"))
                    k = local[w] = len(extra)
                    extra.append(found)
                to.append(k)
            number[misses] = self.n_words + np.array(to, np.int64)
            lens = np.fromiter(map(len, extra), np.int64, len(extra))
            offsets = np.concatenate([offsets, offsets[-1] + np.cumsum(lens)])
            ids = np.concatenate([ids, np.array([i for x in extra for i in x], np.int32)])
        begin = offsets[number].astype(np.int64)
        many = offsets[number + 1] - begin
        before = np.cumsum(many) - many
        out = ids[np.repeat(begin - before, many) + np.arange(int(many.sum()))]
        cuts = np.append(before, int(many.sum()))[np.searchsorted(starts, np.append(text_at, len(cps)))]
        return out, np.diff(cuts)

    def _with_special(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Texts are cut at the strings of special tokens, leftmost first, longest first."""
        import re

        pattern = re.compile("(" + "|".join(map(re.escape, self.special)) + ")")
        ids, counts = [], []
        for t in texts:
            parts = pattern.split(t)
            plain, sizes = Encoder._plain(self, parts[::2])
            own, at = [], 0
            for i, size in enumerate(sizes.tolist()):
                own.append(plain[at : at + size])
                at += size
                if 2 * i + 1 < len(parts):
                    own.append(np.array([self.m.special[parts[2 * i + 1]]], np.int32))
            ids.append(np.concatenate(own))
            counts.append(len(ids[-1]))
        return np.concatenate(ids), np.array(counts)

    def _plain(self, parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        special, self.special = self.special, []
        try:
            return self.encode(parts)
        finally:
            self.special = special

    def decode(self, ids: np.ndarray) -> bytes:
        """Bytes of the ids' tokens."""
        size = self.token_size[ids]
        before = np.cumsum(size) - size
        return self.token_bytes[np.repeat(self.token_at[ids] - before, size) + np.arange(int(size.sum()))].tobytes()


# --- the distributed operator ----------------------------------------------------------------


def word_counts(docs: DataFrame, classes_file: str) -> DataFrame:
    """w, n: how often each pre-tokenised word occurs in all texts."""
    ship(docs.sparkSession)

    def run(batches):
        classes = _mapped(classes_file)["classes"]
        counts: Counter = Counter()
        for whole in batches:
            for b in slices(whole, "text"):
                texts = [t for t in b.column("text").to_pylist() if t]
                joined = "".join(texts)
                sizes = np.fromiter(map(len, texts), np.int64, len(texts))
                starts = split_words(np.frombuffer(joined.encode("utf-32-le"), np.uint32), np.cumsum(sizes) - sizes, classes).tolist()
                counts.update(map(joined.__getitem__, map(slice, starts, [*starts[1:], len(joined)])))
                if len(counts) > 200_000:
                    yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], ["w", "n"])
                    counts = Counter()
        yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], ["w", "n"])

    return docs.select("text").mapInArrow(run, "w string, n long").groupBy("w").agg(F.sum("n").alias("n"))


def frequent_words(docs: DataFrame, classes_file: str, most: int = LEXICON_WORDS) -> list[str]:
    """The words above the lowest count level that leaves at most `most` of them.

    Levels are eighths of an octave, so the driver receives a few hundred level sizes
    and then at most `most` words, whatever the corpus.
    """
    counts = word_counts(docs, classes_file).where("n > 1 and length(w) <= 64")
    counts = counts.select("w", F.floor(F.log2("n") * 8).cast("int").alias("level")).cache()
    try:
        held, least = 0, None
        for level, n in sorted(((r[0], r[1]) for r in counts.groupBy("level").count().collect()), reverse=True):
            if held + n > most:
                break
            held, least = held + n, level
        return [] if least is None else [r[0] for r in counts.where(F.col("level") >= least).select("w").toLocalIterator()]
    finally:
        counts.unpersist()


_MAPPED: dict = {}


def _mapped(name: str) -> dict[str, np.ndarray]:
    """The arrays of a shipped file, memory-mapped; numpy maps stored members of the archive in place."""
    if name not in _MAPPED:
        _MAPPED.clear()
        path = SparkFiles.get(name)
        out = {}
        with zipfile.ZipFile(path) as z, open(path, "rb") as f:
            for info in z.infolist():
                f.seek(info.header_offset)
                head = f.read(30)
                f.seek(info.header_offset + 30 + int.from_bytes(head[26:28], "little") + int.from_bytes(head[28:30], "little"))
                version = np.lib.format.read_magic(f)
                shape, _, dtype = np.lib.format.read_array_header_1_0(f) if version == (1, 0) else np.lib.format.read_array_header_2_0(f)
                count = int(np.prod(shape))
                out[info.filename.removesuffix(".npy")] = np.memmap(path, dtype, "r", f.tell(), shape).view(np.ndarray) if count else np.empty(shape, dtype)
        _MAPPED[name] = out
    return _MAPPED[name]


def _ship_arrays(spark: SparkSession, arrays: dict[str, np.ndarray], kind: str) -> str:
    """Send arrays to all executors, also later ones, through Spark's file distribution."""
    name = f"{kind}-{uuid.uuid4().hex}.npz"
    path = os.path.join(tempfile.mkdtemp(prefix="corpuloom-lexicon-"), name)
    np.savez(path, **arrays)
    spark.sparkContext.addFile(path)
    return name


_ENCODERS: dict = {}


def _encoder(tokenizer: str, lexicon_file: str) -> Encoder:
    key = (tokenizer, lexicon_file)
    if key not in _ENCODERS:
        _ENCODERS.clear()
        arrays = _mapped(lexicon_file)
        _ENCODERS[key] = Encoder(Merger(tokenizer), arrays, arrays["classes"])
    return _ENCODERS[key]


def make_lexicon(docs: DataFrame, tokenizer: str = DEFAULT_TOKENIZER, most: int = LEXICON_WORDS) -> str:
    """Count the words of all texts, compile the frequent ones, and ship the automaton; returns its file name."""
    spark = docs.sparkSession
    classes = character_classes()
    file = _ship_arrays(spark, {"classes": classes}, "classes")
    words = frequent_words(docs, file, most)
    return _ship_arrays(spark, {"classes": classes, **build_lexicon(words, Merger(tokenizer))}, "lexicon")


def bpe_encode(docs: DataFrame, tokenizer: str = DEFAULT_TOKENIZER, lexicon: str | None = None) -> DataFrame:
    """doc_id and ids (array<int>) of every whole text, as the tokenizers library gives them without added special tokens.

    A null text counts as empty and has no ids. Repeated rows are encoded again; other
    columns are ignored; an empty table gives an empty result and an empty lexicon.
    """
    ship(docs.sparkSession)
    lexicon = lexicon or make_lexicon(docs, tokenizer)

    def run(batches):
        enc = _encoder(tokenizer, lexicon)
        for whole in batches:
            for b in slices(whole, "text"):
                ids, many = enc.encode([t or "" for t in b.column("text").to_pylist()])
                ends = np.concatenate([[0], np.cumsum(many)]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.ListArray.from_arrays(pa.array(ends), pa.array(ids.astype(np.int32)))], ["doc_id", "ids"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, ids array<int>")


def decode_bytes(raw: bytes) -> str:
    """Text of decoded bytes; malformed UTF-8 becomes U+FFFD as in the library."""
    return raw.decode("utf-8", "replace")


def bpe_digest(docs: DataFrame, tokenizer: str = DEFAULT_TOKENIZER, lexicon: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256: ids are encoded, decoded again and digested where they are made.

    Nulls, repeated rows, other columns and empty tables as in bpe_encode().
    """
    ship(docs.sparkSession)
    lexicon = lexicon or make_lexicon(docs, tokenizer)

    def run(batches):
        enc = _encoder(tokenizer, lexicon)
        number = [b"%d," % i for i in range(enc.m.size)].__getitem__
        for whole in batches:
            for b in slices(whole, "text"):
                ids, many = enc.encode([t or "" for t in b.column("text").to_pylist()])
                raw = enc.decode(ids)
                size = enc.token_size[ids]
                ends = np.cumsum(many)
                byte_ends = np.append(0, np.cumsum(size))[ends].tolist()
                as_list = ids.tolist()
                first, second, start, at = [], [], 0, 0
                for end, byte_end in zip(ends.tolist(), byte_ends, strict=True):
                    first.append(hashlib.sha256(b"".join(map(number, as_list[start:end]))[:-1]).hexdigest())
                    second.append(hashlib.sha256(decode_bytes(raw[at:byte_end]).encode("utf-8")).hexdigest())
                    start, at = end, byte_end
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(many, pa.int64()), pa.array(first), pa.array(second)], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: the number of its token ids by the public vocabulary, the digest of the ids, and that of the text decoded from them; a null text is empty."""
    return bpe_digest(table(spark, sf_dir, "documents"))
