"""Token ids of whole texts by the tokenizers library, with a cache of its results for single pieces.

A byte-level BPE file splits a text by one fixed pattern and encodes each piece by itself, so the library's ids for a
piece hold wherever the piece occurs. Where no blanks meet, no piece has one inside, so a text may be split before each blank. Arrow does this
and numbers the distinct chunks of a batch, without a comma or full stop at their ends; only those not seen before are
split by the pattern, and only their new pieces go to the library. Texts where blanks meet are split by the pattern as a
whole. Texts with characters beyond Latin, where the versions of Unicode behind two pattern engines could differ, with
special tokens' strings, or under a file of another kind go to the library as they are.
"""

from __future__ import annotations

import json
import os
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex

from .common import release

VOCABULARY = "byte_bpe_50k.json"
#: Fixed value: the pattern by which byte-level BPE files of this kind split a text.
PATTERN = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
BEYOND = "[^\t\n\r\x20-\x7e¡-ɏ]"
BLANKS = "[\t\n\r ][\t\n\r ]"
ALNUM = np.array([chr(i).isalnum() for i in range(128)] + [False] * 128)
#: Bytes of text encoded at a time.
PART_BYTES = 7 << 20
#: Chunks kept, in two generations, and pieces in a generation.
CACHE = 500_000
#: What the library gets at a time, as it takes some hundred bytes for each of them: code points (or one text), and words.
CALL_CHARS, CALL_WORDS = 1 << 18, 1 << 14
#: Chunks whose ids are put in place at a time.
CALL_ROWS = 1 << 18


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Encoder:
    """Pieces' ids are kept as bytes in two generations: when the young one is full it becomes the old one, and what is
    used again moves over, so that frequent pieces stay and memory is bounded by twice `cache` pieces."""

    def __init__(self, path: str, cache: int = CACHE):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer, self.cache = Tokenizer.from_file(path), cache
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.chunks: dict[bytes, bytes] = {}
        self.old_chunks: dict[bytes, bytes] = {}
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.special = [t["content"] for t in spec.get("added_tokens") or ()]
        split = spec.get("pre_tokenizer") or {}
        self.by_piece = split.get("type") == "ByteLevel" and split.get("use_regex", True) and not split.get("add_prefix_space") and not spec.get("normalizer") and not spec.get("post_processor")
        # Ids of tokens that begin with a blank; in this alphabet it is written as one letter.
        self.blank = np.zeros(self.tokenizer.get_vocab_size() + 1, dtype=bool)
        self.blank[[i for t, i in self.tokenizer.get_vocab().items() if t.startswith("\u0120")]] = True

    def whole(self, texts: list[str]) -> list[bytes]:
        """The library's ids of each text, as uint32."""
        out, first, size = [], 0, 0
        for k, t in enumerate(texts, 1):
            size += len(t)
            if size > CALL_CHARS or k - first >= CALL_WORDS or k == len(texts):
                out += [np.array(e.ids, dtype=np.uint32).tobytes() for e in self.tokenizer.encode_batch_fast(texts[first:k], add_special_tokens=False)]
                first, size = k, 0
        return out

    def of_texts(self, texts: list[str]) -> list[bytes]:
        """The ids of each text, by its pieces."""
        if len(self.young) > self.cache:
            self.young, self.old = {}, self.young
        young, old = self.young, self.old
        lists = list(map(PATTERN.findall, texts))
        if missing := {p for pieces in lists for p in pieces if p not in young}:
            known = {p: x for p in missing if (x := old.get(p))}
            young.update(known)
            if len(missing) > len(known):
                new = [p for p in missing if p not in known]
                young.update(zip(new, self.whole(new)))
        return [young[p[0]] if len(p) == 1 else b"".join(map(young.__getitem__, p)) for p in lists]

    def of_chunks(self, chunks: list[bytes]) -> list[bytes]:
        """The ids of each chunk with what stands before it: a line's end for those that begin with its sign, else a blank."""
        if len(self.chunks) > self.cache // 2:
            self.chunks, self.old_chunks = {}, self.chunks
        found = list(map(self.chunks.get, chunks))
        missing = [c for c, x in zip(chunks, found) if x is None]
        if missing:
            before = list(map(self.old_chunks.get, missing))
            self.chunks.update((c, x) for c, x in zip(missing, before) if x is not None)
            new = [c for c, x in zip(missing, before) if x is None]
            texts = [("\n" + t[1:] if t[:1] == "\1" else " " + t) for t in map(bytes.decode, new)]
            words = [(c, t) for c, t in zip(new, texts) if t[1:].isalpha() and t[0] == " "]
            # Words are pieces: the library splits a text of them before each blank.
            for i in range(0, len(words), CALL_WORDS):
                some = words[i : i + CALL_WORDS]
                data = self.whole(["".join([t for _, t in some])])[0]
                ids = np.frombuffer(data, dtype=np.uint32)
                cuts = np.flatnonzero(self.blank[ids])
                if len(cuts) == len(some):
                    bounds = (4 * np.r_[cuts, len(ids)]).tolist()
                    self.chunks.update((c, data[a:b]) for (c, _), a, b in zip(some, bounds, bounds[1:]))
            rest = [(c, t) for c, t in zip(new, texts) if c not in self.chunks]
            self.chunks.update(zip((c for c, _ in rest), self.of_texts([t for _, t in rest])))
            found = list(map(self.chunks.__getitem__, chunks))
        return found

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts as uint32, places at which each text's begin, and the end); texts: strings without nulls."""
        texts = texts.cast(pa.large_string())
        odd = pc.match_substring_regex(texts, BEYOND) if self.by_piece else pa.array([True] * len(texts))
        for special in self.special:
            odd = pc.or_(odd, pc.match_substring(texts, special))
        tight = pc.and_(pc.invert(odd), pc.match_substring_regex(texts, BLANKS))
        odd, tight = (np.flatnonzero(x.to_numpy(zero_copy_only=False)) for x in (odd, tight))
        single = self.whole(texts.take(pa.array(odd)).to_pylist())
        single += self.of_texts(texts.take(pa.array(tight)).to_pylist())
        whole = np.r_[odd, tight]
        rest = np.setdiff1d(np.arange(len(texts)), whole)
        inner = texts.take(pa.array(rest))
        first = [t.split(" ", 1)[0].split("\n", 1)[0] for t in inner.to_pylist()]
        # A line's end becomes a blank and a sign for it, so that what follows is a chunk by itself.
        split = pc.split_pattern(pc.replace_substring(inner, "\n", " \1"), " ")
        begin = split.offsets.to_numpy().copy()
        distinct = split.values.cast(pa.large_binary()).dictionary_encode()
        del inner, split
        which, chunks = distinct.indices.to_numpy(), distinct.dictionary
        mark = self.marks(chunks)
        stems = pc.if_else(pa.array(mark > 0), pc.binary_slice(chunks, 0, -1), chunks).dictionary_encode()
        parts = self.of_chunks(stems.dictionary.to_pylist())
        number, mark = stems.indices.to_numpy().astype(np.int32)[which], mark[which]
        del distinct, which, chunks, stems
        number[begin[:-1]] = len(parts) + np.arange(len(rest))
        mark[begin[:-1]] = 0
        parts += self.of_texts(first)
        counts = np.zeros(len(texts), dtype=np.int64)
        counts[rest] = np.diff(begin)
        counts[whole] = 1
        ends = np.cumsum(counts)
        row, marked = (np.zeros(int(ends[-1]) if len(ends) else 0, dtype=np.int32) for _ in range(2))
        split_up = np.ones(len(row), dtype=bool)
        split_up[ends[whole] - 1] = False
        row[split_up], marked[split_up] = number, mark
        row[ends[whole] - 1] = len(parts) + np.arange(len(whole))
        parts += single
        # Each row's ids from the joined ones, with one place more where a mark follows: a running sum of steps, which
        # are 1 but at the rows' first ids.
        flat = np.frombuffer(b"".join([*parts, bytes(4)]), dtype=np.uint32)
        sizes = np.fromiter(map(len, parts), dtype=np.int32, count=len(parts)) // 4
        del number, mark, split_up, parts, single
        at = (np.cumsum(sizes) - sizes).astype(np.int32)
        count = sizes[row] + (marked > 0)
        place = np.r_[0, np.cumsum(count)]
        ids = np.empty(place[-1], dtype=np.uint32)
        for i in range(0, len(row), CALL_ROWS):
            own, most = count[i : i + CALL_ROWS], place[min(i + CALL_ROWS, len(row))]
            some = np.flatnonzero(own)
            step = np.ones(most - place[i], dtype=np.int32)
            step[place[i + some] - place[i]] = np.diff(at[row[i + some]], prepend=np.int32(0)) - np.r_[0, own[some] - 1][: len(some)].astype(np.int32)
            np.cumsum(step, out=step)
            ids[place[i] : most] = flat[step]
        ids[place[1:][marked > 0] - 1] = marked[marked > 0]
        ends = np.r_[0, place[ends]]
        del flat, row, marked, count, place
        release()
        return ids, ends

    def marks(self, chunks: pa.Array) -> np.ndarray:
        """The id of the comma or full stop at the end of each chunk, if it follows a letter or digit and so is a piece; else 0."""
        ends = np.frombuffer(chunks.buffers()[1], dtype=np.int64)[chunks.offset : chunks.offset + len(chunks) + 1]
        data = np.frombuffer(chunks.buffers()[2] or b"", dtype=np.uint8)
        out = np.zeros(len(chunks), dtype=np.int32)
        at = np.flatnonzero(np.diff(ends) > 2)
        last = data[ends[at + 1] - 1]
        at, last = at[(last == 44) | (last == 46)], last[(last == 44) | (last == 46)]
        before, lead = data[ends[at + 1] - 2], data[ends[at + 1] - 3]
        word = (before < 128) & ALNUM[before] | (lead == 0xC3) & (before >= 128) & (before != 0x97) & (before != 0xB7)
        for sign, text in ((44, ","), (46, ".")):
            ids = np.frombuffer(self.of_texts([text])[0], dtype=np.uint32)
            if len(ids) == 1 and ids[0] > 0:
                out[at[word & (last == sign)]] = ids[0]
        return out


def in_parts(texts: pa.Array, most_bytes: int = PART_BYTES):
    """(first, array) of runs of texts of so many bytes, or of one text."""
    sizes = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < len(texts):
        before = int(sizes[at - 1]) if at else 0
        end = max(at + 1, int(np.searchsorted(sizes, before + most_bytes, side="right")))
        yield at, texts.slice(at, end - at)
        at = end


@lru_cache(maxsize=1)
def encoder(path: str) -> Encoder:
    """One for a Python worker, over all its tasks."""
    return Encoder(path)
