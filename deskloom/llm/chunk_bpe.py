"""Byte-level BPE over whole texts through the tokenizers library, encoding each distinct chunk once.

The pre-tokenizer never joins characters across the start of an optional space plus a run without
white space, nor across white-space runs. A text is therefore the concatenation of such chunks, and
each chunk's ids depend on the chunk alone. A worker keeps the ids of chunks it has met (up to a
bound) and sends only new ones to the library, many in one call.
"""

from __future__ import annotations

import os
import re

import numpy as np

from .held import held

SPACE = "\t-\r \x85\xa0  -     　"  # fixed values: Unicode White_Space
_FAST = re.compile(r" ?\S+|\s+(?!\S)|\s+")
_SURE = re.compile(f" ?[^{SPACE}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+")
_ODD = re.compile("[\x1c-\x1f]")  # white space to Python's \s alone


def chunks(text: str) -> list[str]:
    return (_SURE if _ODD.search(text) else _FAST).findall(text)


class _Seen(dict):
    def __init__(self):
        super().__init__()
        self.new: list[str] = []

    def __missing__(self, chunk: str) -> int:
        self[chunk] = k = len(self)
        self.new.append(chunk)
        return k


class ChunkEncoder:
    """Encodes lists of texts to one flat id array plus a length per text."""

    def __init__(self, path: str, keep: int = 600_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.keep = keep
        self.special = [t.content for t in self.tok.get_added_tokens_decoder().values()]
        size = self.tok.get_vocab_size()
        self.width = np.zeros(size, np.int64)
        for token, i in self.tok.get_vocab(with_added_tokens=True).items():
            self.width[i] = len(token)
        self.dtype = np.dtype("<u2" if size <= 1 << 16 else "<u4")
        self._reset()

    def _reset(self) -> None:
        self.seen = _Seen()
        self.flat = np.empty(1 << 16, self.dtype)
        self.used = 0
        self.first = np.empty(1 << 14, np.int64)
        self.count = np.empty(1 << 14, np.int32)

    def _store(self, k: int, ids: np.ndarray, first: np.ndarray, count: np.ndarray) -> None:
        while self.used + len(ids) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.empty_like(self.flat)])
        while k + len(first) > len(self.first):
            self.first = np.concatenate([self.first, np.empty_like(self.first)])
            self.count = np.concatenate([self.count, np.empty_like(self.count)])
        self.flat[self.used : self.used + len(ids)] = ids
        self.first[k : k + len(first)] = first + self.used
        self.count[k : k + len(first)] = count
        self.used += len(ids)

    def _learn(self, new: list[str], k: int) -> None:
        """Ids of the new chunks, numbered from k: joined into strings that fall apart at the same places."""
        at = 0
        while at < len(new):
            text, ends, lead, size = [], [], [], 0
            while at < len(new) and size < 200_000:
                c = new[at]
                # a chunk without its own leading space follows a line feed, a token of its own; white space goes alone
                if c[0] == " " and len(c) > 1 and not c.isspace():
                    pre = ""
                elif c.isspace() or not c.strip():
                    if text:
                        break
                    text, ends, lead, size = [c], [len(c.encode())], [0], 1 << 30
                    at += 1
                    continue
                else:
                    pre = "\n"
                b = len(c.encode("utf-8", "surrogatepass"))
                text.append(pre + c)
                size += b + len(pre)
                ends.append(size)
                lead.append(len(pre))
                at += 1
            ids = np.asarray(self.tok.encode_batch_fast(["".join(text)], add_special_tokens=False)[0].ids, np.int64)
            stop = np.searchsorted(np.cumsum(self.width[ids]), np.asarray(ends)) + 1
            if size >= 1 << 30:
                stop = np.asarray([len(ids)])
            first = np.concatenate([[0], stop[:-1]]) + np.asarray(lead)  # the line feed is one token
            self._store(k, ids, first, stop - first)
            k += len(ends)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids of all texts and the number of ids of each; equals the library's encode of each whole text."""
        out, lengths, run = [], np.zeros(len(texts), np.int64), []
        size = 0
        for i, t in enumerate(texts):
            if any(s in t for s in self.special):
                self._flush(texts, run, out, lengths)
                run, size = [], 0
                ids = np.asarray(self.tok.encode(t, add_special_tokens=False).ids, self.dtype)
                out.append(ids)
                lengths[i] = len(ids)
                continue
            run.append(i)
            size += len(t)
            if size > 2_000_000:
                self._flush(texts, run, out, lengths)
                run, size = [], 0
        self._flush(texts, run, out, lengths)
        return (np.concatenate(out) if out else np.empty(0, self.dtype)), lengths

    def _flush(self, texts: list[str], run: list[int], out: list, lengths: np.ndarray) -> None:
        if not run:
            return
        if len(self.seen) > self.keep:
            self._reset()
        codes, per = [], []
        known = len(self.seen)
        for i in run:
            c = chunks(texts[i])
            per.append(len(c))
            codes.append(np.fromiter(map(self.seen.__getitem__, c), np.int32, len(c)))
        if self.seen.new:
            self._learn(self.seen.new, known)
            self.seen.new = []
        codes = np.concatenate(codes)
        count = self.count[codes].astype(np.int64)
        ends = np.cumsum(count)
        bounds = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(per)])]
        lengths[run] = np.diff(bounds)
        total = int(ends[-1]) if len(ends) else 0
        pick = np.arange(total, dtype=np.int64) + np.repeat(self.first[codes] - (ends - count), count)
        out.append(self.flat[pick])


def encoder(path: str) -> ChunkEncoder:
    """One encoder for each worker process and vocabulary file."""
    return held(("chunks", path), lambda: ChunkEncoder(path))
