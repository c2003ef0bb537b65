"""Token ids through the tokenizers library, with a memo of words.

A tokenizer that lowers case, drops white space and marks word ends encodes a text as the ids of its
white-space-separated chunks, one after the other, and a chunk as the ids of its runs of letters, its digits and its
runs of marks. So each distinct chunk gets a number when it is first met; the runs that the memo lacks go through
the library, many at a time; and the ids of the texts are gathered by number. Texts with something for which
that identity could fail, and all texts under other tokenizers, are encoded whole.

The memo is only a speed-up: dropping it changes no result. It is bounded in bytes; when it is full, the chunks that
most of the parts since the last time held stay, up to half the bound, but none of over LONGEST characters.
"""

from __future__ import annotations

import functools
import json
import os
import re
from collections.abc import Iterator

import numpy as np
import regex

#: Separators of str.split() that the tokenizer's \\s does not know, letters whose lower case isn't one letter or depends on the neighbours, and how special tokens begin.
ODD = re.compile("[\x1c-\x1fΣİ]|<\\|")
#: What each of those begins with, as one class, which is searched for fast.
SELDOM = re.compile("[\x1c-\x1fΣİ<]")
#: Runs of a chunk in lower case that are encoded by themselves; a fixed value of the tokenizer's format.
RUNS = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+")
#: Characters below this are their own normal form, alone and beside each other.
NORMAL = re.compile("[\x00-\u02ff]*")
#: Entries of the memo, each of so many bytes beside its characters and ids; characters of a chunk that is kept.
LIMIT, ENTRY_BYTES, LONGEST = 400_000, 250, 64
#: Characters of the texts that are encoded at once, and how many texts these are at most.
PART_CHARS, PART_ROWS = 4 << 20, 8192


#: Letters that stand for bytes: a byte's own character where that is printable, else the next of those from U+0100. A fixed value of the format.
SHOWN = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
LETTERS = {x: x for x in SHOWN} | {x: 0x100 + k for k, x in enumerate(sorted({*range(256)} - {*SHOWN}))}


def byte_level(run: str) -> str:
    return run.encode().decode("latin-1").translate(LETTERS)


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def parts_of(texts: list[str]) -> Iterator[list[str]]:
    """texts in runs of about PART_CHARS characters; a longer text is a run."""
    held, chars = [], 0
    for text in texts:
        if held and (chars + len(text) > PART_CHARS or len(held) == PART_ROWS):
            yield held
            held, chars = [], 0
        held.append(text)
        chars += len(text)
    if held:
        yield held


class Numbers(dict):
    """Numbers of chunks in the order in which they were first met."""

    def __init__(self) -> None:
        super().__init__()
        self.names: list[str] = []

    def __missing__(self, chunk: str) -> int:
        self[chunk] = k = len(self.names)
        self.names.append(chunk)
        return k


class Encoder:
    """Ids of whole texts."""

    def __init__(self, path: str, limit: int = LIMIT):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a worker has one core
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer, self.most = Tokenizer.from_file(path), limit * ENTRY_BYTES
        told = lambda x: json.loads(x.__getstate__()) if x is not None else {}
        normal, split = told(self.tokenizer.normalizer), told(self.tokenizer.pre_tokenizer)
        suffix = getattr(self.tokenizer.model, "end_of_word_suffix", None)
        lowers = any(x.get("type") == "Lowercase" for x in normal.get("normalizers", []))
        splits = [x for x in split.get("pretokenizers", []) if x.get("type") == "Split" and x.get("behavior") == "Removed" and x.get("invert")]
        self.by_word = bool(suffix) and lowers and bool(splits)
        if self.by_word:
            # The same model, for runs that are in normal form and in the alphabet of bytes already.
            self.bare = Tokenizer(self.tokenizer.model)
            self.bare.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
            # Whether a chunk may be cut by RUNS: whether the tokenizer cuts by the same rule and maps bytes after it.
            pattern = splits[0].get("pattern", {}).get("Regex", "").replace("[\\p{L}]+", "\\p{L}+").replace("[\\p{N}]", "\\p{N}")
            bytes_after = [x for x in split["pretokenizers"] if x.get("type") == "ByteLevel" and not x.get("add_prefix_space") and not x.get("use_regex")]
            self.by_run = pattern == RUNS.pattern and bool(bytes_after)
            self.ends = np.zeros(self.tokenizer.get_vocab_size(with_added_tokens=True), bool)
            for k in range(len(self.ends)):
                self.ends[k] = (self.tokenizer.id_to_token(k) or "").endswith(suffix)
            self._forget()

    def _forget(self) -> None:
        self.memo, self.held = Numbers(), 0
        #: Ids of the chunks, one after the other, and where each one's begin; the last entry is where the next one's will.
        self.ids, self.first = np.empty(1 << 16, "<u4"), np.zeros(1 << 14, np.int64)
        self.known, self.parts = 0, np.zeros(0, np.uint16)

    def _whole(self, texts: list[str]) -> list[bytes]:
        return [np.asarray(x.ids, "<u4").tobytes() for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _runs(self, runs: list[str]) -> Iterator[tuple[str, bytes]]:
        """Runs, joined so that the library is called seldom; word ends tell their ids apart."""
        normal, plain = [], []
        for run in runs:
            (normal if self.by_run and NORMAL.fullmatch(run) else plain).append(run)
        for tokenizer, some in ((self.bare, normal), (self.tokenizer, plain)):
            for at in range(0, len(some), 4000):
                part = some[at : at + 4000]
                given = part if tokenizer is self.tokenizer else [x if x.isascii() and x.isprintable() else byte_level(x) for x in part]
                ids = np.asarray(tokenizer.encode_batch_fast([" ".join(given)], add_special_tokens=False)[0].ids, "<u4")
                cuts = (np.flatnonzero(self.ends[ids]) + 1) * 4
                if len(cuts) != len(part):
                    yield from zip(part, self._whole(part), strict=True)
                    continue
                body, low = ids.tobytes(), 0
                for run, high in zip(part, cuts.tolist(), strict=True):
                    yield run, body[low:high]
                    low = high

    def _bytes_of(self, chunk: str) -> bytes | None:
        k = self.memo.get(chunk, self.known)
        return self.ids[self.first[k] : self.first[k + 1]].tobytes() if k < self.known else None

    def _learn(self) -> None:
        """Ids of the chunks that have a number and no ids."""
        new = self.memo.names[self.known :]
        if not new:
            return
        cut = {x: RUNS.findall(x) for x in new if not x.isalpha() and self.by_run and NORMAL.fullmatch(x)}
        found: dict[str, bytes] = {}
        wanted = {x for x in new if x not in cut}
        for run in {y for x in cut.values() for y in x}:
            if run in wanted:
                continue
            if (known := self._bytes_of(run)) is None:
                wanted.add(run)
            else:
                found[run] = known
        found.update(self._runs(list(wanted)))
        values = [b"".join([found[y] for y in cut[x]]) if x in cut else found[x] for x in new]
        body = np.frombuffer(b"".join(values), "<u4")
        low = int(self.first[self.known])
        while low + len(body) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.empty_like(self.ids)])
        while len(self.memo.names) + 1 > len(self.first):
            self.first = np.concatenate([self.first, np.empty_like(self.first)])
        self.ids[low : low + len(body)] = body
        self.first[self.known + 1 : len(self.memo.names) + 1] = low + np.cumsum(np.fromiter(map(len, values), np.int64, len(values)) // 4)
        self.held += sum(map(len, new)) + 4 * len(body) + ENTRY_BYTES * len(new)
        self.known = len(self.memo.names)

    def _bound(self, codes: np.ndarray) -> None:
        """Count the part's chunks; when the memo is full, those that most parts held stay, each counted as new."""
        seen = np.bincount(codes, minlength=self.known) > 0
        seen[: len(self.parts)] &= self.parts < np.iinfo(np.uint16).max
        self.parts = np.concatenate([self.parts, np.zeros(self.known - len(self.parts), np.uint16)]) + seen.astype(np.uint16)
        if self.held <= self.most:
            return
        names, ids, first, parts = self.memo.names, self.ids, self.first, self.parts
        often = np.flatnonzero(parts > 1)
        often = often[np.argsort(-parts[often].astype(np.int64), kind="stable")][: self.most // (2 * ENTRY_BYTES)]
        kept = [k for k in often.tolist() if len(names[k]) <= LONGEST]
        self._forget()
        if kept:
            for k in kept:
                self.memo[names[k]]
            values = [ids[first[k] : first[k + 1]] for k in kept]
            self.ids = np.concatenate([*values, np.empty(1 << 16, "<u4")])
            self.first = np.concatenate([[0], np.cumsum([len(x) for x in values]), np.zeros(1 << 14, np.int64)])
            self.held = sum(map(len, self.memo.names)) + 4 * sum(map(len, values)) + ENTRY_BYTES * len(kept)
            self.known, self.parts = len(kept), np.ones(len(kept), np.uint16)

    def _numbered(self, part: list[str]) -> tuple[np.ndarray, np.ndarray, dict[int, bytes]]:
        """The numbers of all chunks, how many each text has, and the ids of the texts that are encoded whole."""
        odd = [k for k, x in enumerate(part) if SELDOM.search(x) and ODD.search(x)] if self.by_word else list(range(len(part)))
        whole = dict(zip(odd, self._whole([part[k] for k in odd]), strict=True))
        if not self.by_word:
            return np.empty(0, np.int64), np.zeros(len(part), np.int64), whole
        number = self.memo.__getitem__
        codes, counts = [], np.zeros(len(part), np.int64)
        for k, text in enumerate(part):
            if k not in whole:
                chunks = text.lower().split()
                counts[k] = len(chunks)
                codes.append(np.fromiter(map(number, chunks), np.int64, len(chunks)))
        self._learn()
        return np.concatenate(codes) if codes else np.empty(0, np.int64), counts, whole

    def lengths(self, texts: list[str]) -> np.ndarray:
        """How many ids each text has."""
        out = [np.empty(0, np.int64)]
        for part in parts_of(texts):
            codes, counts, whole = self._numbered(part)
            n = self.first[codes + 1] - self.first[codes] if len(codes) else codes
            ends = np.cumsum(counts)
            sums = np.concatenate([[0], np.cumsum(n)])
            sizes = sums[ends] - sums[ends - counts]
            for k, body in whole.items():
                sizes[k] = len(body) // 4
            out.append(sizes)
            if self.by_word:
                self._bound(codes)
        return np.concatenate(out)

    def flat(self, texts: list[str], end_id: int | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For each part of the texts: all their ids, and where each text's begin (and the last ends). end_id follows each text."""
        end = np.asarray([] if end_id is None else [end_id], "<u4")
        for part in parts_of(texts):
            codes, counts, whole = self._numbered(part)
            first = self.first[codes] if len(codes) else codes
            n = self.first[codes + 1] - first if len(codes) else codes
            sums = np.concatenate([[0], np.cumsum(n)])
            ends = np.cumsum(counts)
            at = sums[np.concatenate([[0], ends])]
            # Of each id, its place among the memo's.
            body = self.ids[np.repeat(first - sums[:-1], n) + np.arange(sums[-1])] if len(codes) else np.empty(0, "<u4")
            if whole:
                pieces = [np.frombuffer(whole[k], "<u4") if k in whole else body[at[k] : at[k + 1]] for k in range(len(part))]
                at = np.concatenate([[0], np.cumsum([len(x) for x in pieces])])
                body = np.concatenate(pieces)
            if len(end):
                body = np.insert(body, at[1:], end_id)
                at = at + np.arange(len(at))
            yield body.astype("<u4", copy=False), at
            if self.by_word:
                self._bound(codes)

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        return [ids[a:b].tobytes() for ids, at in self.flat(texts) for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]


@functools.cache
def encoder(path: str) -> Encoder:
    """One encoder for each path in each Python worker."""
    return Encoder(path)
