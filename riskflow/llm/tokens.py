"""Token ids of whole texts, with the ids of each distinct word looked up once.

The byte-level pattern never joins text across a space, or a line feed, that stands between two characters that are not
white space: it opens a token, or is one. Texts are cut there, and only pieces not seen before go to the tokenizer.
"""

from __future__ import annotations

import json
import os
import re

import numpy as np

#: Bytes, about, that one Python worker remembers of pieces and their ids; beyond them it starts anew.
REMEMBERED_BYTES = 32 << 20
#: Words of printable characters below this are the same to every version of the Unicode tables.
PLAIN = "\u0250"
CUT = re.compile(r"(?<=\S)(?= \S)")
_encoders: dict[str, Encoder] = {}


def byte_alphabet() -> dict[str, int]:
    """The characters by which a byte-level vocabulary writes bytes: printable ones stand for themselves, the others are numbered from 256."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


def fast_tokenizer(path: str):
    """The same byte-pair merges in a faster library, for words of letters below ``PLAIN``; None unless the file is a plain
    byte-level vocabulary in the order of its merges, split by the pattern of ``public_tokenizers``.
    """
    with open(path, encoding="utf-8") as file:
        spec = json.load(file)
    model, before = spec["model"], spec.get("pre_tokenizer") or {}
    merges = [x if isinstance(x, list) else x.split(" ") for x in model.get("merges", [])]
    if model.get("type") != "BPE" or spec.get("normalizer") or before.get("type") != "ByteLevel" or before.get("add_prefix_space") or not before.get("use_regex"):
        return None
    if any(model["vocab"].get("".join(x)) != 256 + i for i, x in enumerate(merges)):
        return None
    import public_tokenizers
    import tiktoken

    alphabet = byte_alphabet()
    ranks = {bytes(alphabet[c] for c in token): i for token, i in model["vocab"].items() if i < 256 + len(merges)}
    return tiktoken.Encoding("plain", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


class Slots(dict):
    """Numbers for pieces in the order in which they are first asked for; new ones wait in ``new``."""

    def __init__(self, owner: Encoder):
        self.owner, self.new = owner, []

    def __missing__(self, piece: str) -> int:
        slot = self[piece] = self.owner.slots
        self.owner.slots += 1
        self.owner.held += 180 + 4 * len(piece)
        self.new.append(piece)
        return slot


class Encoder:
    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [x.content for x in self.tokenizer.get_added_tokens_decoder().values()]
        self.fast = fast_tokenizer(path)
        (self.feed,) = self._ids("\n")
        self.forget()

    def _ids(self, text: str) -> list[int]:
        return self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids

    def forget(self) -> None:
        self.slots = self.used = self.held = 0
        self.spaced, self.whole = Slots(self), Slots(self)  # pieces that follow a space, without it; other pieces
        self.ids = np.zeros(1 << 16, dtype=np.int32)
        self.starts, self.lengths = np.zeros(1 << 12, dtype=np.int64), np.zeros(1 << 12, dtype=np.int32)

    def _keep(self, slots: list[int], ids: np.ndarray, begins: np.ndarray, lengths: np.ndarray) -> None:
        while self.used + len(ids) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        self.ids[self.used : self.used + len(ids)] = ids
        self.starts[slots], self.lengths[slots] = begins + self.used, lengths
        self.used += len(ids)
        self.held += 8 * len(ids)

    def _learn(self, slots: list[int], pieces: list[str], before: str, feed: bool) -> None:
        """Many pieces at a time, with a line feed, a token of its own, between them; ``feed``: it belongs to each piece."""
        for at in range(0, len(pieces), 256):
            some = pieces[at : at + 256]
            text = "\n".join([before + p for p in some])
            plain = self.fast and max(text) < PLAIN and "".join(some).isprintable() and not any(x in text for x in self.special)
            ids = np.array([self.feed, *(self.fast.encode_ordinary(text) if plain else self._ids(text))], dtype=np.int32)
            begins = np.flatnonzero(ids == self.feed)
            if len(begins) != len(some):
                raise RuntimeError("the tokenizer joins line feeds to words")
            lengths = np.diff(begins, append=len(ids))
            self._keep(slots[at : at + 256], ids, begins + (not feed), lengths - (not feed))

    def _learn_new(self) -> None:
        while self.slots > len(self.lengths):
            self.starts, self.lengths = np.concatenate([self.starts, np.zeros_like(self.starts)]), np.concatenate([self.lengths, np.zeros_like(self.lengths)])
        plain, led, single = ([], []), ([], []), ([], [])
        for piece in self.spaced.new:
            led_by_feed = piece[:1] == "\n"
            bare = piece[1:] if led_by_feed else piece
            if not bare or bare[0].isspace() or bare[-1].isspace() or "\n" in bare:
                self.lengths[self.spaced[piece]] = -1  # white space beside the space: not a place to cut
            else:
                into = led if led_by_feed else plain
                into[0].append(self.spaced[piece])
                into[1].append(bare)
        self._learn(*plain, " ", False)
        self._learn(*led, "", True)
        for piece in self.whole.new:
            if piece and "\n" not in piece and piece == piece.strip():
                single[0].append(self.whole[piece])
                single[1].append(piece)
            else:
                ids = np.array(self._ids(piece), dtype=np.int32)
                self._keep([self.whole[piece]], ids, np.zeros(1, np.int64), np.array([len(ids)]))
        self._learn(*single, "", False)
        self.spaced.new.clear()
        self.whole.new.clear()

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text, as the tokenizer gives them for the text at once."""
        if self.held > REMEMBERED_BYTES:
            self.forget()
        cut = []
        for text in texts:
            first, *rest = text.replace("\n", " \n").split(" ")
            at = np.empty(len(rest) + 1, dtype=np.int64)
            at[0] = self.whole[first]
            at[1:] = np.fromiter(map(self.spaced.__getitem__, rest), dtype=np.int64, count=len(rest))
            cut.append(at)
        self._learn_new()
        apart = [i for i, at in enumerate(cut) if self.lengths[at].min() < 0]
        for i in apart:
            cut[i] = np.array([self.whole[p] for p in CUT.split(texts[i])], dtype=np.int64)
        if apart:
            self._learn_new()
        out = []
        for at in cut:
            n = self.lengths[at]
            ends = np.cumsum(n)
            out.append(self.ids[np.repeat(self.starts[at] - ends + n, n) + np.arange(ends[-1])])
        return out


def encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]
