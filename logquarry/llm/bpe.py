"""The tokenizer libraries behind one face: whole texts to ids, counts, or pieces with their counts."""

from __future__ import annotations

import json
import os

import numpy as np

#: Fixed value: the splitting pattern of byte-level vocabularies, which a .tiktoken file does not hold.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Different pieces whose counts are kept.
KEPT = 500_000
#: Around a character, what shows whether the library and the pattern see it alike.
AROUND = ("a{0}a", "1{0}1", " {0} ", ".{0}.", "{0}{0}", "  {0}", "'{0}")
#: What a pattern must not hold if its matches are to depend only on what follows: it would look back, or at the ends of the text.
LOOKS_BACK = ("(?<", "^", "$", "\\b", "\\B", "\\A", "\\z", "\\Z", "\\G", "\\K")


def _reads_forwards(pre: dict | None) -> bool:
    """Whether a splitting rule reads only forwards from a piece's start, and adds nothing."""
    if not pre:
        return False
    kind = pre["type"]
    if kind == "Sequence":
        parts = pre["pretokenizers"]
        return len(parts) == 2 and parts[0]["type"] == "Split" and _reads_forwards(parts[0]) and parts[1]["type"] == "ByteLevel" and not parts[1]["use_regex"] and not parts[1]["add_prefix_space"]
    if kind == "Split":
        pattern = pre["pattern"].get("Regex", "")
        plain = pattern.replace("[^", "[")
        return bool(pattern) and pre["behavior"] == "Isolated" and not pre["invert"] and not any(x in plain for x in LOOKS_BACK)
    return kind == "ByteLevel" and pre["use_regex"] and not pre["add_prefix_space"]


class Encoder:
    """Token ids and counts of texts, as the library gives them for the vocabulary file at path: .json, .tiktoken or .model.

    ``special``: strings that the library takes for tokens wherever they stand in a text. ``forward``:
    whether pieces depend only on what follows their start, so that a text may be encoded in chunks.

    Where it is so, counts of short texts come from their pieces: the pattern of the file splits a text,
    and the library encodes each different piece once. That is only done for characters that the
    library and the pattern have been seen to treat alike, and for pieces that the library leaves whole;
    other texts go through the library as they are.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.special: list[str] = []
        self.forward = False
        if path.endswith(".tiktoken"):
            import base64

            import tiktoken

            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
            core = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
            self.size = max(ranks.values()) + 1
            self._ids = lambda texts: [core.encode_to_numpy(x, disallowed_special=()) for x in texts]
        elif path.endswith(".model"):
            import sentencepiece

            core = sentencepiece.SentencePieceProcessor(model_file=path)
            self.size = core.get_piece_size()
            self._ids = lambda texts: [np.array(x, np.uint32) for x in core.encode(texts, num_threads=1)]
        else:
            from tokenizers import Tokenizer, processors

            self._core = core = Tokenizer.from_file(path)
            core.no_truncation()
            core.no_padding()
            spec = json.load(open(path))
            self.size = core.get_vocab_size(with_added_tokens=True)
            added = spec.get("added_tokens") or []
            self.special = [t["content"] for t in added]
            plain = not any(t[flag] for t in added for flag in ("single_word", "lstrip", "rstrip", "normalized"))
            apart = not any(a[i:] == b[: len(a) - i] for a in self.special for b in self.special for i in range(1, len(a))) and not any(a != b and a in b for a in self.special for b in self.special)
            self.forward = plain and apart and spec.get("normalizer") is None and _reads_forwards(spec.get("pre_tokenizer"))
            if self.forward:  # ids stay as they are; offsets then include the space before a word
                import regex

                core.post_processor = processors.ByteLevel(trim_offsets=False)
                pre = spec["pre_tokenizer"]
                pattern = pre["pretokenizers"][0]["pattern"]["Regex"] if pre["type"] == "Sequence" else PATTERN
                self._split = regex.compile(pattern.replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}"))
                self._alike: dict[str, bool] = {}
                self._pieces: dict[str, int] = {}  # tokens of a piece; -1 for one that is split when it stands alone
            self._ids = lambda texts: [np.array(e.ids, np.uint32) for e in core.encode_batch_fast(texts, add_special_tokens=False)]

    def ids(self, texts: list[str]) -> list[np.ndarray]:
        return self._ids(texts)

    def _sees_alike(self, c: str) -> bool:
        ok = True
        for around in AROUND:
            text = around.format(c)
            spans = [m.span() for m in self._split.finditer(text)]
            ok = ok and [x for _, x in self._core.pre_tokenizer.pre_tokenize_str(text)] == spans
        return ok

    def _known(self, text: str) -> bool:
        seen = self._alike
        for c in set(text).difference(seen):
            seen[c] = self._sees_alike(c)
        return all(seen.values()) or all(seen[c] for c in set(text))

    def _by_pieces(self, texts: list[str]) -> list[int]:
        """Tokens of each text from its pieces; -1 if they cannot tell."""
        if len(self._pieces) > KEPT:
            self._pieces.clear()
        kept, split = self._pieces, self._split
        parts = [split.findall(x) if self._known(x) and not any(s in x for s in self.special) else None for x in texts]
        new = {p for x in parts if x for p in x}.difference(kept)
        whole = [p for p in new if split.findall(p) == [p]]
        kept.update(dict.fromkeys(new, -1))
        kept.update(zip(whole, map(len, self._core.encode_batch_fast(whole, add_special_tokens=False)), strict=True))
        counts = [None if x is None else list(map(kept.__getitem__, x)) for x in parts]
        return [-1 if n is None or n and min(n) < 0 else sum(n) for n in counts]

    def counts(self, texts: list[str]) -> list[int]:
        if not hasattr(self, "_core"):
            return [len(x) for x in self._ids(texts)]
        out = self._by_pieces(texts) if self.forward else [-1] * len(texts)
        rest = [i for i, n in enumerate(out) if n < 0]
        for i, e in zip(rest, self._core.encode_batch_fast([texts[i] for i in rest], add_special_tokens=False), strict=True):
            out[i] = len(e)
        return out

    def pieces(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """The start of each piece of a text without special strings, and its tokens, from the library's offsets."""
        e = self._core.encode(text, add_special_tokens=False)
        if not len(e):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        word = np.array(e.word_ids, np.int64)
        first = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
        return np.array([a for a, _ in e.offsets], np.int64)[first], np.diff(np.append(first, len(word)))


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]
