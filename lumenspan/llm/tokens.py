"""Token ids of whole texts by a tokenizers file, with a bounded memo of words."""

from __future__ import annotations

import json
import os
import re
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

#: Characters whose words are numbered at a time; the arrays made of them are about 10 times as large.
STEP = 2 << 20

_KEPT: dict[str, Pieces] = {}


def pieces(path: str) -> Pieces:
    """The encoder of a tokenizers file; a Python worker keeps it, with its memo, for its next tasks."""
    if path not in _KEPT:
        _KEPT[path] = Pieces(path)
    return _KEPT[path]


def forget() -> None:
    """Give back the memos of this worker, for operators that need its memory for something else."""
    _KEPT.clear()


class Pieces:
    """Encodes texts as little-endian unsigned 16-bit ids.

    A pre-tokenizer of either kind here always cuts before a blank or a line feed that stands alone between two other
    characters, and between a letter and a full stop or comma. So the ids of the words, one after the other, are
    the ids of the text. The words of many texts are numbered by Arrow, so that each distinct one is looked up once; a line
    feed is a blank where a tokenizer keeps neither. Words recur: one that has been met before is kept in a memo of at most ``most`` words, and new
    ones are handed to the tokenizer many at a time, told apart by their first tokens (where tokens keep the blank), by
    their last ones (words of letters, where tokens mark a word's end) or by a mark between them. Texts with other white space are cut by a pattern instead. A full
    memo keeps its older half: words that were met first are the frequent ones.

    Where a tokenizer only composes, folds white space and lowers, that is done by Python for texts of Latin-1, in
    which it is the same, and the words go to a copy without these steps. A text with ``<|`` takes all steps of the tokenizer then, as
    its control tokens are found before letters are lowered.
    """

    CUT = re.compile(r"(?<=\S)(?=[ \n]\S)")

    MARK = "\x01"

    def __init__(self, path: str, most: int = 600_000):
        from tokenizers import Tokenizer
        from tokenizers.normalizers import Sequence

        self.path, self.whole = path, None
        self.tokenizer = Tokenizer.from_file(path)
        steps = json.loads(self.tokenizer.to_str())["normalizer"] or {}
        kinds = {x["type"] for x in steps.get("normalizers", [steps] if steps else [])}
        self.lowers = "Lowercase" in kinds and kinds <= {"NFC", "Replace", "Lowercase"}
        if self.lowers:
            self.tokenizer.normalizer = Sequence([])
        if self.tokenizer.get_vocab_size() > 1 << 16:
            raise ValueError("ids of more than 16 bits")
        self.memo: dict[str, bytes] = {}
        self.most = most
        self.keeps_blank = self._ids(["a b"])[0] != self._ids(["a\nb"])[0] or self._ids([" a"])[0] != self._ids(["a"])[0]
        self.first, self.last = np.zeros(1 << 16, bool), np.zeros(1 << 16, bool)
        for token, i in self.tokenizer.get_vocab().items():
            self.first[i], self.last[i] = token[:1] in "ĠĊ", token.endswith("</w>")
        mark = np.frombuffer(self._ids([self.MARK])[0], "<u2")
        self.mark = int(mark[0]) if len(mark) == 1 else -1
        self.stop = dict(zip(".,", self._ids([".", ","]), strict=True))
        self.met = bytearray(1 << 21)

    def _ids(self, texts: list[str]) -> list[bytes]:
        """Ids of texts that need no normalisation any more; a bounded number at a time."""
        out: list[bytes] = []
        for i in range(0, len(texts), 32):
            out += [np.array(x.ids, "<u2").tobytes() for x in self.tokenizer.encode_batch_fast(texts[i : i + 32], add_special_tokens=False)]
        return out

    def _as_is(self, text: str) -> bytes:
        """Ids of any text, cut where that is safe; the tokenizer with all its steps is loaded when it is first needed."""
        if self.whole is None:
            from tokenizers import Tokenizer

            self.whole = Tokenizer.from_file(self.path) if self.lowers else self.tokenizer
        return b"".join(np.array(x.ids, "<u2").tobytes() for x in self.whole.encode_batch_fast(self.CUT.split(text), add_special_tokens=False))

    def _together(self, words: list[str]) -> list[bytes]:
        """Ids of words that each start with a blank or a line feed and have no other white space."""
        groups = [words[i : i + 256] for i in range(0, len(words), 256)]
        out: list[bytes] = []
        for group, raw in zip(groups, self._ids(["".join(g) for g in groups]), strict=True):
            ids = np.frombuffer(raw, "<u2")
            if self.keeps_blank:
                at = np.append(np.flatnonzero(self.first[ids]), len(ids))
            else:
                at = np.append(0, np.flatnonzero(self.last[ids]) + 1)
            at = (2 * at).tolist()
            parts = [raw[a:b] for a, b in zip(at[:-1], at[1:], strict=True)]
            out += parts if len(parts) == len(group) else self._ids(group)
        return out

    def _apart(self, words: list[str]) -> list[bytes]:
        """Ids of words without blanks, with a mark that no text here holds between them."""
        out: list[bytes] = []
        groups = [words[i : i + 256] for i in range(0, len(words), 256)]
        for group, raw in zip(groups, self._ids([f" {self.MARK} ".join(g) for g in groups]), strict=True):
            at = np.flatnonzero(np.frombuffer(raw, "<u2") == self.mark) * 2
            parts = [raw[a:b] for a, b in zip([0, *(at + 2).tolist()], [*at.tolist(), len(raw)], strict=True)]
            out += parts if len(parts) == len(group) else self._ids(group)
        return out

    def _learn(self, new: set[str]) -> dict[str, bytes]:
        """Ids of words that the memo lacks. A word stands without its blank; one that begins a text has a NUL before it where tokens keep the blank."""
        ends, stems, odd, mixed = [], set(), [], []
        for w in new:
            if w[-1] in ".," and w[-2:-1].isalpha():
                ends.append(w)
                w = w[:-1]
                if w in self.memo:
                    continue
            if w[0] == "\0" or "<|" in w:
                odd.append(w)
            elif not self.keeps_blank and not w.isalpha():
                mixed.append(w)
            else:
                stems.add(w)
        plain = list(stems)
        out = dict(zip(plain, self._together([w if w[0] == "\n" else f" {w}" for w in plain]), strict=True))
        out.update(zip(odd, self._ids([w[1:] if w[0] == "\0" else w if w[0] == "\n" else f" {w}" for w in odd]), strict=True))
        out.update(zip(mixed, self._apart(mixed), strict=True))
        for w in ends:
            stem = w[:-1]
            out[w] = (out.get(stem) or self.memo.get(stem, b"")) + self.stop[w[-1]]
        return out

    def _keep(self, learned: dict[str, bytes]) -> None:
        """Take words into the memo that have been met before; the others, most of which never come again, only leave a mark."""
        met = self.met
        for w, ids in learned.items():
            h = hash(w) & 0xFFFFFF
            bit = 1 << (h & 7)
            if met[h >> 3] & bit:
                self.memo[w] = ids
            else:
                met[h >> 3] |= bit

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text; null has none. About ``STEP`` characters are taken at a time, a longer text by itself."""
        out: list[bytes] = []
        some: list[str | None] = []
        size = 0
        for x in texts:
            if some and size + len(x or "") > STEP:
                out += self._encoded(some)
                some, size = [], 0
            some.append(x)
            size += len(x or "")
        return out + self._encoded(some)

    def _encoded(self, texts: list[str | None]) -> list[bytes]:
        out: list[bytes] = [b""] * len(texts)
        rows, lines, counts = [], [], []
        for i, x in enumerate(texts):
            if not x:
                continue
            t = x.replace("\n", " \n" if self.keeps_blank else " ")
            # only blanks and line feeds as white space, each alone and between other characters; no control characters
            if x.replace("\n", "").isprintable() and "  " not in t and "\n " not in t and t[0] != " " and t[-1] not in " \n" and not (self.lowers and ("<|" in x or not latin(x))):
                rows.append(i)
                lines.append(("\0" if self.keeps_blank else "") + (t.lower() if self.lowers else t))
                counts.append(t.count(" ") + 1)
            else:
                out[i] = self._as_is(x)
        if not rows:
            return out
        # the words as numbers of the distinct ones, so that only these are looked up; their ids are then laid side by side
        numbered = pc.split_pattern(pa.array([" ".join(lines)], pa.large_string()), " ").flatten().dictionary_encode()
        del lines
        words = numbered.dictionary.to_numpy(zero_copy_only=False).tolist()
        numbers = numbered.indices
        del numbered
        known = list(map(self.memo.get, words))
        at = [i for i, v in enumerate(known) if v is None]
        learned = self._learn({words[i] for i in at})
        for i in at:
            known[i] = learned[words[i]]
        laid = pa.array(known, pa.large_binary()).take(numbers)
        del known, words, numbers
        _, offsets, data = laid.buffers()
        data = data or pa.py_buffer(b"")
        ends = np.frombuffer(offsets, np.int64)[np.cumsum([0, *counts])].tolist()
        for i, a, b in zip(rows, ends[:-1], ends[1:], strict=True):
            out[i] = data[a:b].to_pybytes()
        self._keep(learned)
        if len(self.memo) > self.most:
            self.memo = dict(islice(self.memo.items(), self.most // 2))
        return out


def latin(text: str) -> bool:
    """Whether the text is all Latin-1."""
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True
