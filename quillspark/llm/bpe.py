"""BPE encoding and decoding with content-defined chunk reuse.

A text's bytes are cut where a rolling hash of the last 16 bytes has a given pattern, so that the same passage is cut
alike wherever it stands. What a chunk has between its first and its last white space is encoded once in each task and
kept, by its bytes, in a cache of bounded size; copies and shared passages find their chunks there.

At each join the words that the cut may have torn are put together, over as many chunks as it takes to reach white space.
The join is then encoded anew by the library, together with the last whole word of the chunk before and the first of the
chunk after, and must give exactly the tokens that the parts have. Where it does not, both chunks are encoded anew as one,
and the joins on both sides of that are held to it again, until all agree; in the end that is the whole text.

Chunks are encoded by words. Words that are not known come many at a time: their pre-tokens are found by the library's
own classes of characters, and merges are made in all of them at once, each pre-token's lowest rank first. Long words and
those with special tokens are left to the library, and so are whole chunks if a tokenizer file is of another form.

Memory is bounded by one group of texts, both caches and the longest text; caches are let go when a task ends.

Decoding looks up each id's token; the vocabulary has no decoder, so tokens are joined by spaces.

Defined cases: null text is empty and has no token; its ids and decoded text are empty strings. Rows stand for
themselves, repeated or not. Other columns are not read, except those named to be carried.
"""

from __future__ import annotations

import hashlib
import json
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Cut where these bits of the rolling hash are all set: a chunk has 512 bytes on average.
MASK = np.uint32(0x01FF0000)
WINDOW = 16
#: Chunks up to this size are kept; about so many bytes of chunks and of words, as Python holds them.
KEEP_CHUNK, KEEP_BYTES, KEEP_WORD_BYTES = 4096, 16 << 20, 48 << 20
#: What Python needs for a word or a chunk besides their bytes.
_WORD_BYTES, _CHUNK_BYTES = 180, 350
#: Texts that are encoded together, in bytes, and unknown words that are.
GROUP_BYTES, LEARN = 2 << 20, 8192
#: Longer words go to the library.
LONG_WORD = 64
_GEAR = np.random.default_rng(20).integers(0, 1 << 32, 256, dtype=np.uint32)

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
#: Classes of characters.
_UNKNOWN, _BLANK, _LETTER, _NUMBER, _OTHER, _SEPARATOR = range(6)
_NEVER = np.int32(1 << 30)
#: The form of the tokenizer file that is encoded by words; others are left to the library.
_NORMALIZERS = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]
_PRE_TOKENS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_PRE_TOKENIZERS = [
    {"type": "Split", "pattern": {"Regex": _PRE_TOKENS}, "behavior": "Removed", "invert": True},
    {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
]
END = "</w>"


def cuts(data: bytes) -> list[int]:
    """Where data is cut: after the bytes at which the rolling hash fits, on code point boundaries."""
    if len(data) <= WINDOW:
        return []
    b = np.frombuffer(data, dtype=np.uint8)
    h = _GEAR[b]
    k = 1
    while k < WINDOW:  # h covers k bytes; with the k bytes before, shifted, it covers 2k
        h[k:] += h[:-k].copy() << np.uint32(k)
        k *= 2
    at = np.flatnonzero((h & MASK) == MASK) + 1
    at = at[(at >= WINDOW) & (at < len(data))]
    return at[(b[at] & 0xC0) != 0x80].tolist()


def _byte_letters() -> list[str]:
    """The letter that stands for each byte in a byte-level vocabulary: itself if it can be printed, else the next from U+0100 on."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    more = iter(range(0x100, 0x200))
    return [chr(b) if b in shown else chr(next(more)) for b in range(256)]


class Merges:
    """A vocabulary's merges, made in many pre-tokens at once."""

    def __init__(self, vocab: dict[str, int], merges: list[tuple[str, str]]):
        letters = _byte_letters()
        self.byte = np.array([vocab[c] for c in letters], dtype=np.int32)
        self.last_byte = np.array([vocab[c + END] for c in letters], dtype=np.int32)
        self.n = len(vocab)
        made: dict[str, int] = {}
        for rank, (a, b) in enumerate(merges):
            # a merge comes after those that make its parts: then the lowest rank can be merged everywhere at once
            if any(len(p.removesuffix(END)) > 1 and p not in made for p in (a, b)) or a + b in made:
                raise ValueError("merges out of order")
            made[a + b] = rank
        self.merged = np.array([vocab[a + b] for a, b in merges], dtype=np.int32)
        keys = np.array([vocab[a] * self.n + vocab[b] for a, b in merges], dtype=np.int64)
        self.slots = 18
        self.keys, self.ranks = np.full(1 << self.slots, -1, dtype=np.int64), np.full(1 << self.slots, _NEVER, dtype=np.int32)
        for rank, (slot, key) in enumerate(zip(self._slot(keys).tolist(), keys.tolist(), strict=True)):
            while self.keys[slot] >= 0:
                slot = (slot + 1) % len(self.keys)
            self.keys[slot], self.ranks[slot] = key, rank

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.slots)).astype(np.int64)

    def rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The rank of each pair of tokens, _NEVER if there is none."""
        keys = a.astype(np.int64) * self.n + b
        slot = self._slot(keys)
        there = self.keys[slot]
        out = np.where(there == keys, self.ranks[slot], _NEVER)
        rest = np.flatnonzero((there != keys) & (there >= 0))
        while len(rest):
            slot[rest] = (slot[rest] + 1) & (len(self.keys) - 1)
            there = self.keys[slot[rest]]
            same = there == keys[rest]
            out[rest[same]] = self.ranks[slot[rest[same]]]
            rest = rest[~same & (there >= 0)]
        return out

    def run(self, data: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(token ids, owner of each) of bytes whose owner is the number of their pre-token, in order."""
        last = np.append(owner[1:] != owner[:-1], True)
        tokens = np.where(last, self.last_byte[data], self.byte[data])
        out, place, of = np.full(len(data), -1, dtype=np.int32), np.arange(len(data)), owner
        while len(tokens):
            rank = np.append(np.where(of[1:] == of[:-1], self.rank(tokens[:-1], tokens[1:]), _NEVER), _NEVER)
            starts = np.flatnonzero(np.append(True, of[1:] != of[:-1]))
            low = np.repeat(np.minimum.reduceat(rank, starts), np.diff(np.append(starts, len(of))))
            done = low == _NEVER
            out[place[done]] = tokens[done]
            at = np.flatnonzero((rank == low) & ~done)
            # of pairs that overlap, as in aaa, every other one from the left
            first = np.flatnonzero(np.append(True, np.diff(at) != 1))
            nth = np.arange(len(at)) - np.repeat(first, np.diff(np.append(first, len(at)))) if len(at) else at
            at = at[nth % 2 == 0]
            tokens[at] = self.merged[rank[at]]
            stay = ~done
            stay[at + 1] = False
            tokens, place, of = tokens[stay], place[stay], of[stay]
        kept = out >= 0
        return out[kept], owner[kept]


class Chunk:
    """What lies between the first and the last white space of a chunk: its tokens, and those of its outermost words."""

    __slots__ = ("words", "ids", "first", "last", "head", "tail")

    def __init__(self, data: bytes, by_words: bool = True):
        self.words = data.split() if by_words else [data]
        self.ids = self.first = self.last = b""
        # the ends of the first word and the start of the last, from either side
        self.head = self.tail = 0 if by_words else len(data)
        if by_words and self.words:
            self.head = len(data) - len(data.lstrip()) + len(self.words[0])
            self.tail = len(data) - len(data.rstrip()) + len(self.words[-1])

    def fill(self, coded: list[bytes]) -> None:
        self.words, self.ids = (), b"".join(coded)
        if coded:
            self.first, self.last = coded[0], coded[-1]


class Coder:
    """One tokenizer file, with caches."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        with open(path, encoding="utf-8") as f:
            form = json.load(f)
        self.special = [t["content"].encode() for t in form["added_tokens"]]
        self.tokens = [(self.library.id_to_token(i) or "").encode() for i in range(self.library.get_vocab_size(with_added_tokens=True))]
        model = form["model"]
        self.by_words = (
            (form["normalizer"] or {}).get("normalizers") == _NORMALIZERS
            and (form["pre_tokenizer"] or {}).get("pretokenizers") == _PRE_TOKENIZERS
            and not form["post_processor"] and not form["decoder"] and model["type"] == "BPE" and model["end_of_word_suffix"] == END
            and not any(model.get(x) for x in ("dropout", "unk_token", "continuing_subword_prefix", "fuse_unk", "byte_fallback", "ignore_merges"))
            and all(not (t["lstrip"] or t["rstrip"] or t["normalized"] or t["single_word"]) for t in form["added_tokens"])
        )
        self.merges = None
        if self.by_words:
            try:
                self.merges = Merges(model["vocab"], [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]])
            except (KeyError, ValueError):
                pass
        self.classes = np.full(0x110000, _UNKNOWN, dtype=np.uint8)
        self.classes[0] = _SEPARATOR
        self.forget()

    def forget(self) -> None:
        """Lets go of what the caches hold."""
        self.words: dict[bytes, bytes] = {}
        self.chunks: dict[bytes, Chunk] = {}
        self.kept_bytes = self.word_bytes = self.hits = self.misses = self.repairs = 0

    def decode(self, ids: bytes) -> bytes:
        numbers = np.frombuffer(ids, dtype="<u4").tolist()
        if not self.by_words:
            return self.library.decode(numbers, skip_special_tokens=False).encode()
        return b" ".join(map(self.tokens.__getitem__, numbers))

    def _whole(self, data: list[bytes]) -> list[bytes]:
        """The ids that the library gives for each text."""
        return [np.array(x.ids, dtype="<u4").tobytes() for x in self.library.encode_batch_fast([d.decode() for d in data], add_special_tokens=False)]

    def _class(self, points: np.ndarray) -> np.ndarray:
        """The class of each code point; one that has not been seen is tried on the library's own pre-tokenizer."""
        out = self.classes[points]
        if not out.all():
            cut_up = self.library.pre_tokenizer.pre_tokenize_str
            for p in np.unique(points[out == _UNKNOWN]).tolist():
                c = chr(p)
                twice = len(cut_up(c + c))
                self.classes[p] = _BLANK if twice == 0 else _NUMBER if twice == 2 else _LETTER if len(cut_up("a" + c)) == 1 else _OTHER
            out = self.classes[points]
        return out

    def _pre_tokens(self, text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of words in normal form with U+0000 between them: the bytes of all pre-tokens, each byte's pre-token, each pre-token's word."""
        points = np.frombuffer(text.encode("utf-32-le"), dtype="<u4")
        kind = self._class(points)
        before = np.append(np.uint8(_SEPARATOR), kind[:-1])
        inside = (kind != _BLANK) & (kind != _SEPARATOR)
        start = inside & ((kind != before) | (kind == _NUMBER))
        # 's 't 'm 'd 're 've 'll, where a pre-token begins with the tick
        tick = np.flatnonzero((points == 39) & (before != _OTHER))
        if len(tick):
            padded = np.append(points, np.zeros(3, dtype=points.dtype))
            one, two = padded[tick + 1], padded[tick + 2]
            size = np.where(np.isin(one, [115, 116, 109, 100]), 2, 0)
            size[((one == 114) | (one == 118)) & (two == 101) | (one == 108) & (two == 108)] = 3
            tick, size = tick[size > 0], size[size > 0]
            start[tick + 1] = False
            after = tick + size
            after = after[after < len(points)]
            start[after] = inside[after]
        token = np.cumsum(start) - 1
        word = np.cumsum(kind == _SEPARATOR)[start]
        width = 1 + (points >= 0x80).astype(np.int8) + (points >= 0x800) + (points >= 0x10000)
        spread = np.repeat(np.where(inside, token, -1), width)
        data = np.frombuffer(text.encode(), dtype=np.uint8)
        return data[spread >= 0], spread[spread >= 0], word

    def _learn(self, new: list[bytes]) -> dict[bytes, bytes]:
        """Encodes words that are not known."""
        odd = (b"\0", *self.special)
        if self.merges:
            joined = b" ".join(new)
            found = [x for x in odd if x in joined]
            hard = [w for w in new if len(w) > LONG_WORD or any(x in w for x in found)]
        else:
            hard = new
        out = dict(zip(hard, self._whole(hard), strict=True))
        easy = [w for w in new if w not in out] if hard else new
        for k in range(0, len(easy), LEARN):
            part = easy[k : k + LEARN]
            joined = b"\0".join(part)
            text = joined.lower().decode() if joined.isascii() else self.library.normalizer.normalize_str(joined.decode())
            ids, of = self.merges.run(*(found := self._pre_tokens(text))[:2])
            raw = ids.astype("<u4").tobytes()
            ends = (4 * np.cumsum(np.bincount(found[2][of], minlength=len(part)))).tolist()
            out.update(zip(part, [raw[s:e] for s, e in zip([0, *ends], ends, strict=False)], strict=True))
        size = sum(map(len, out)) + sum(map(len, out.values())) + _WORD_BYTES * len(out)
        if self.word_bytes + size > KEEP_WORD_BYTES:
            self.words.clear()
            self.word_bytes = 0
        if size <= KEEP_WORD_BYTES:
            self.words.update(out)
            self.word_bytes += size
        return out

    def _encode_words(self, words: list[bytes]) -> list[bytes]:
        got = list(map(self.words.get, words))
        if None in got:
            new = self._learn(list(dict.fromkeys([w for w, g in zip(words, got, strict=True) if g is None])))
            got = [new[w] if g is None else g for w, g in zip(words, got, strict=True)]
        return got

    def _chunk(self, data: bytes, fresh: list[Chunk]) -> Chunk:
        """The chunk as it is kept; a new one, which goes to fresh, has words still to be encoded."""
        kept = self.chunks.get(data)
        if kept is not None:
            self.hits += 1
            return kept
        self.misses += 1
        out = Chunk(data, self.by_words)
        fresh.append(out)
        if len(data) <= KEEP_CHUNK:
            if self.kept_bytes > KEEP_BYTES:
                self.chunks.clear()
                self.kept_bytes = 0
            self.chunks[data] = out
            self.kept_bytes += len(data)
        return out

    def _parts(self, data: bytes, fresh: list[Chunk]) -> list[tuple[int, int, Chunk]]:
        """(start, end, chunk) from white space to white space; the words between are those that cuts may have torn."""
        ends = np.array([*cuts(data), len(data)])
        spaces = np.flatnonzero(_SPACE[np.frombuffer(data, dtype=np.uint8)])
        # of each chunk, the numbers of its first white space and of the next chunk's
        first = np.searchsorted(spaces, np.concatenate(([0], ends[:-1])))
        after = np.searchsorted(spaces, ends)
        has = first < after  # without white space the join goes on
        inner = list(zip(spaces[first[has]].tolist(), (spaces[after[has] - 1] + 1).tolist(), strict=True))
        out = [(s, e, self._chunk(data[s:e], fresh)) for s, e in inner]
        # what stands before the first and after the last white space
        outer = [(0, inner[0][0] if inner else len(data)), (inner[-1][1] if inner else len(data), len(data))]
        for at, (s, e) in zip((0, len(out) + 1), outer, strict=True):
            if s < e:
                out.insert(at, (s, e, Chunk(data[s:e], False)))
                fresh.append(out[min(at, len(out) - 1)][2])
        return out

    def _joined(self, data: bytes, parts: list[tuple[int, int, Chunk]], ok: list[bool]) -> list[tuple[int, int, Chunk]]:
        """parts with those encoded anew as one between which the join does not agree (ok: whether it does)."""
        parts, ok, k = list(parts), list(ok), 0
        while k < len(ok):
            if ok[k]:
                k += 1
                continue
            self.repairs += 1
            (start, _, a), (_, end, b) = parts[k], parts[k + 1]
            ids = self._whole([data[start:end]])[0]
            one = Chunk(b"")
            one.ids, one.first, one.last, one.head, one.tail = ids, a.first, b.last, a.head, b.tail
            agrees = ids.startswith(a.first), ids.endswith(b.last)
            parts[k : k + 2] = [(start, end, one)]
            del ok[k]
            if k < len(ok):
                ok[k] = ok[k] and agrees[1]
            if k and not (ok[k - 1] and agrees[0]):
                ok[k - 1] = False
                k -= 1
        return parts

    def encode_all(self, texts: list[bytes]) -> list[tuple[bytes, bytes]]:
        """(ids as little-endian 32-bit numbers, decoded text) of each text in UTF-8."""
        fresh: list[Chunk] = []
        plans, torn_words = [], []
        for data in texts:
            # the case of A to Z means nothing, unless a mark follows that only the small letter composes with
            if data.isascii() and self.merges and not any(s in data.lower() for s in self.special):
                data = data.lower()
            parts = self._parts(data, fresh)
            torn = [data[e:s] for (_, e, _), (s, _, _) in zip(parts, parts[1:], strict=False)]
            plans.append((data, parts, torn))
            torn_words += torn
        coded = self._encode_words([w for c in fresh for w in c.words] + torn_words)
        at = 0
        for c in fresh:
            n = len(c.words)
            c.fill(coded[at : at + n])
            self.kept_bytes += len(c.ids) + _CHUNK_BYTES
            at += n
        windows, wanted = [], []
        for data, parts, torn in plans:
            own = coded[at : at + len(torn)]
            at += len(torn)
            torn[:] = own
            for (_, e, a), (s, _, b), ids in zip(parts, parts[1:], own, strict=False):
                windows.append(data[e - a.tail : s + b.head])
                wanted.append(a.last + ids + b.first)
        ok = [x == y for x, y in zip(self._whole(windows), wanted, strict=True)]
        out, at = [], 0
        for data, parts, torn in plans:
            agree = ok[at : at + len(torn)]
            at += len(torn)
            if not all(agree):
                between = dict(zip([e for _, e, _ in parts[:-1]], torn, strict=True))
                parts = self._joined(data, parts, agree)
                torn = [between[e] for _, e, _ in parts[:-1]]
            pieces = [parts[0][2].ids] if parts else []
            for t, (_, _, c) in zip(torn, parts[1:], strict=True):
                pieces += [t, c.ids]
            ids = b"".join(pieces)
            out.append((ids, self.decode(ids)))
        return out

    def encode(self, data: bytes) -> tuple[bytes, bytes]:
        return self.encode_all([data])[0]


_CODERS: dict[str, Coder] = {}


def coder(path: str) -> Coder:
    """This worker's coder for a tokenizer file."""
    if path not in _CODERS:
        _CODERS[path] = Coder(path)
    return _CODERS[path]


def _utf8(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "replace")


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = (), with_ids: bool = True) -> DataFrame:
    """id_col, carry columns, n_tokens, ids_sha256, decoded_sha256 and token_ids (with_ids) for each row of docs.

    path: the tokenizer's file, on every worker.
    """
    kept = [id_col, *carry]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*kept).schema.fields)
    schema += ", n_tokens long, ids_sha256 string, decoded_sha256 string" + ", token_ids array<int>" * with_ids

    def groups(texts: pa.Array) -> Iterator[tuple[int, list[bytes]]]:
        """(first row, texts) of about GROUP_BYTES each."""
        start, group, size = 0, [], 0
        for k, text in enumerate(texts):
            group.append(_utf8(text.as_py()))
            size += len(group[-1])
            if size >= GROUP_BYTES:
                yield start, group
                start, group, size = k + 1, [], 0
        if group:
            yield start, group

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = coder(path)
        try:
            for whole in batches:
                for start, texts in groups(whole.column(whole.num_columns - 1)):
                    coded = c.encode_all(texts)
                    counts = [len(ids) // 4 for ids, _ in coded]
                    columns = [whole.column(k).slice(start, len(texts)) for k in range(len(kept))]
                    columns += [pa.array(counts, pa.int64()), pa.array([hashlib.sha256(i).hexdigest() for i, _ in coded]), pa.array([hashlib.sha256(d).hexdigest() for _, d in coded])]
                    if with_ids:
                        ends = np.cumsum([0, *counts], dtype=np.int32)
                        columns.append(pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join([i for i, _ in coded]), dtype="<i4"))))
                    yield pa.RecordBatch.from_arrays(columns, names=[*kept, "n_tokens", "ids_sha256", "decoded_sha256", *["token_ids"] * with_ids])
        finally:
            c.forget()

    return docs.select(*kept, docs[text_col].alias("__text")).mapInArrow(run, schema)


def decode(ids: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "token_ids") -> DataFrame:
    """id_col and text for rows of token ids (null: none)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = coder(path)
        for b in batches:
            texts = [c.decode(np.array(x.as_py() or [], dtype="<u4").tobytes()).decode("utf-8") for x in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], names=[id_col, "text"])

    kind = ids.select(id_col).schema[0].dataType.simpleString()
    return ids.select(id_col, F.col(ids_col)).mapInArrow(run, f"`{id_col}` {kind}, text string")
