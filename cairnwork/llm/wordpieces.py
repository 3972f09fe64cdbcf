"""BPE with word ends, encoded by dynamic programming over the prefixes of each word, and decoded.

For a list of merges made by training, every prefix of a word has exactly one last token: the one that may follow the
last token of what is before it. So one pass over a word is enough, whatever its length: an automaton with suffix links
(Aho-Corasick) names the tokens that end at each place, a test of two neighbours tells whether merging would leave the
border between them alone, and the last token of each prefix is kept. The ids are then read backwards.

The tokenizers library's own normaliser and word pattern are applied to each unit between white space, and the ids of
units and words that repeat are remembered (bounded).
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Iterable, Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .common import byte_characters, slices, utf8

SLICE_BYTES = 1 << 20
#: Bytes that a worker remembers in each of two generations (the older one is then dropped), bytes that an entry takes
#: besides its text and ids, and the longest unit that is remembered.
REMEMBERED, ENTRY, LONGEST = 80 << 20, 290, 64
#: Pairs of tokens whose test is remembered, in each of two generations.
PAIRS = 1 << 18
#: Code points from here on stand for a character that ends a word: byte-level characters lie below.
ENDS = 0x1000
#: White space of ASCII. No word goes over it, and it composes with nothing.
_UNIT, _SPACE = re.compile(r"[^ \t-\r]+"), re.compile(r"[ \t-\r]")


class PrefixTable:
    """The last token of each prefix of a word, for one list of merges.

    ``merges`` are pairs of token strings, first ones first; a token that ends a word has ``suffix`` behind it.
    """

    def __init__(self, vocabulary: dict[str, int], merges: list[tuple[str, str]], suffix: str):
        self.suffix = suffix
        self.ids: list[int] = []
        self.names: list[str] = []
        spelt = {self._spell(token): (token, i) for token, i in vocabulary.items() if token and token != suffix}
        number: dict[str, int] = {}
        for name, (token, i) in spelt.items():
            number[name] = len(self.names)
            self.names.append(token)
            self.ids.append(i)
        #: When a token is made (characters are there from the start, at -1), of what, and what a pair makes.
        self.made = [-1] * len(number)
        self.left, self.right = list(range(len(number))), list(range(len(number)))
        self.joined: dict[tuple[int, int], int] = {}
        for time, (a, b) in enumerate(merges):
            left, right = number[self._spell(a)], number[self._spell(b)]
            whole = number[self._spell(a) + self._spell(b)]
            if self.made[whole] >= 0 or (left, right) in self.joined:
                raise ValueError(f"the merges make {a + b!r} twice, so prefixes have no unique last token")
            if max(self.made[left], self.made[right]) >= time or len(self.names[whole]) == 1:
                raise ValueError(f"the merge of {a!r} and {b!r} comes before that of its parts")
            self.made[whole], self.left[whole], self.right[whole] = time, left, right
            self.joined[left, right] = whole
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        self.young: dict[int, bool] = {}
        self.old: dict[int, bool] = {}
        for name, token in number.items():
            # A token that merging never yields from its own text is no token of any text.
            if self.made[token] < 0 and len(name) == 1 or self.made[token] >= 0 and self.parted(self.left[token], self.right[token], self.made[token]):
                self.automaton.add_word(name, len(name) << 20 | token)
        self.automaton.make_automaton()

    def _spell(self, token: str) -> str:
        """The token with its word end told by its last character."""
        if self.suffix and len(token) > len(self.suffix) and token.endswith(self.suffix):
            token = token[: -len(self.suffix)]
            return token[:-1] + chr(ord(token[-1]) + ENDS)
        return token

    def parted(self, a: int, b: int, until: int = 1 << 60) -> bool:
        """Whether merging leaves the border between tokens ``a`` and ``b`` alone before time ``until``.

        Merges are undone, the latest first, on both sides of the border. Two tokens that meet there at some time would
        have been merged if their merge comes before the merge that takes either of them; of equal merges the left one
        comes first.
        """
        made, joined = self.made, self.joined
        # The first time at which what meets at the border now has been taken into something else.
        while True:
            whole = joined.get((a, b))
            if whole is not None and made[whole] < until:
                return False
            x, y = made[a], made[b]
            if x < 0 and y < 0:
                return True
            if x > y:
                # The merge that made ``a`` took its right part: an equal merge over the border comes after it.
                until, a = x, self.right[a]
            else:
                until, b = y + 1, self.left[b]

    def encode(self, word: str) -> list[int]:
        """Token numbers of one word of byte-level characters."""
        if not word:
            return []
        text = word[:-1] + chr(ord(word[-1]) + ENDS) if self.suffix else word
        n, young, old = len(text), self.young, self.old
        # By the number of characters before: the last token of each prefix, and where it begins. -2: not yet found.
        last, before = [-2] * (n + 1), [0] * (n + 1)
        last[0] = -1
        for end, match in self.automaton.iter(text):
            end += 1
            if last[end] != -2:
                continue
            start, token = end - (match >> 20), match & 0xFFFFF
            a = last[start]
            if a >= 0:
                pair = a << 20 | token
                known = young.get(pair)
                if known is None:
                    known = old.get(pair)
                    if known is None:
                        known = self.parted(a, token)
                    if len(young) >= PAIRS:
                        self.young, self.old = young, old = {}, young
                    young[pair] = known
                if not known:
                    continue
            elif a == -2:
                continue
            last[end], before[end] = token, start
        out, at = [], n
        while at:
            if last[at] < 0:
                raise ValueError(f"no token ends at place {at} of {word[:40]!r}")
            out.append(last[at])
            at = before[at]
        out.reverse()
        return out


class WordTokens:
    """A tokenizer file of the tokenizers library: BPE over byte-level words, without dropout or unknown token."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            told = json.load(file)
        model = told["model"]
        if model["type"] != "BPE" or any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "byte_fallback", "ignore_merges")):
            raise ValueError("only plain BPE is encoded over prefixes")
        if told.get("decoder") is not None:
            raise ValueError("only tokenizers without a decoder of their own are decoded here")
        merges = [tuple(m) if not isinstance(m, str) else tuple(m.split(" ", 1)) for m in model["merges"]]
        self.table = PrefixTable(model["vocab"], merges, model.get("end_of_word_suffix") or "")
        if '"ByteLevel"' not in json.dumps(told["pre_tokenizer"]) or '"add_prefix_space": true' in json.dumps(told["pre_tokenizer"]):
            raise ValueError("only words of byte-level characters are encoded here")
        self.lib = Tokenizer.from_file(path)
        self.lib.no_truncation()
        self.lib.no_padding()
        added = {t.content: (i, t) for i, t in self.lib.get_added_tokens_decoder().items() if t.content}
        if any(t.lstrip or t.rstrip or t.single_word or t.normalized for _, t in added.values()):
            raise ValueError("only added tokens that are sought in the text as it is are handled")
        self.added = {content: (np.array([i], "<u4").tobytes(), content) for content, (i, _) in added.items()}
        self.split = re.compile(f"({'|'.join(map(re.escape, sorted(added, key=len, reverse=True)))})") if added else None
        steps = told["normalizer"] or {"normalizers": []}
        steps = steps.get("normalizers", [steps])
        first = (told["pre_tokenizer"] or {}).get("pretokenizers", [{}])[0]
        pattern = first.get("pattern", {}).get("Regex", "") if first.get("behavior") == "Removed" and first.get("invert") else ""
        spaces = [s for s in steps if s["type"] == "Replace" and s.get("pattern") == {"Regex": r"\s+"}]
        # Texts may be cut at white space where no word has any and the normaliser looks at single characters; words of
        # Latin-1 are then found by the file's own pattern, whose classes are spelt out.
        self.cuts = pattern.endswith(r"[^\s\p{L}\p{N}]+") and all(s["type"] in ("NFC", "Lowercase") or s in spaces for s in steps)
        self.lower = any(s["type"] == "Lowercase" for s in steps)
        classes = {r"\p{L}": "L", r"\p{N}": "N"}
        for name, kind in classes.items():
            pattern = pattern.replace(name, "".join(re.escape(chr(c)) for c in range(256) if unicodedata.category(chr(c))[0] == kind))
        self.latin = re.compile(pattern.replace(r"\s", r" \t-\r\x85\xa0")) if self.cuts else None
        self.characters = byte_characters()
        self.bytes = {ord(c): b for b, c in self.characters.items()}
        self.young: dict[str, tuple[bytes, str]] = {}
        self.old: dict[str, tuple[bytes, str]] = {}
        self.held = 0

    def _learn(self, word: str) -> tuple[bytes, str]:
        """Ids and decoded text of one normalised word."""
        found = self.old.get(word)
        if found is None:
            plain = word.isascii() and word.isprintable()
            tokens = self.table.encode(word if plain else word.encode().decode("latin-1").translate(self.characters))
            names = self.table.names
            found = np.array([self.table.ids[t] for t in tokens], "<u4").tobytes(), " ".join([names[t] for t in tokens])
        if len(word) <= LONGEST:
            self.young[word] = found
            self.held += ENTRY + 2 * len(word) + len(found[0]) + len(found[1])
        return found

    def _through(self, part: str) -> list[tuple[bytes, str]]:
        """A part by the library's normaliser and word pattern, whose words come as bytes' characters."""
        normal = self.lib.normalizer.normalize_str(part) if self.lib.normalizer is not None else part
        words = [w.translate(self.bytes).encode("latin-1").decode() for w, _ in self.lib.pre_tokenizer.pre_tokenize_str(normal)]
        return [self.young.get(w) or self._learn(w) for w in words]

    def _found(self, part: str) -> list[tuple[bytes, str]]:
        if not self.cuts:
            return self._through(part)
        try:
            part.encode("latin-1")
        except UnicodeEncodeError:
            if _UNIT.fullmatch(part):
                return self._through(part)
            return [f for unit in _UNIT.findall(part) for f in self._found(unit)]
        words = self.latin.findall(part.lower() if self.lower else part)
        known = list(map(self.young.get, words))
        return known if None not in known else [self._learn(w) if k is None else k for w, k in zip(words, known, strict=True)]

    def encode(self, text: str) -> tuple[bytes, str]:
        """The ids as little-endian 32-bit integers, and what the library's decode gives for them."""
        ids: list[bytes] = []
        decoded: list[str] = []
        for i, part in enumerate(self.split.split(text) if self.split else [text]):
            if i % 2:
                ids.append(self.added[part][0])
                decoded.append(self.added[part][1])
                continue
            for piece in _pieces(part) if self.cuts else [part]:
                if self.held > REMEMBERED:
                    self.young, self.old, self.held = {}, self.young, 0
                found = self._found(piece)
                ids.append(b"".join([f[0] for f in found]))
                if found:
                    decoded.append(" ".join([f[1] for f in found]))
        return b"".join(ids), " ".join(decoded)


def _pieces(text: str) -> Iterator[str]:
    """A text in pieces of about ``SLICE_BYTES`` characters, cut at white space."""
    begin = 0
    while len(text) - begin > SLICE_BYTES:
        space = _SPACE.search(text, begin + SLICE_BYTES)
        if space is None:
            break
        yield text[begin : space.start()]
        begin = space.start()
    yield text[begin:]


@lru_cache(maxsize=2)
def tokens_of(path: str) -> WordTokens:
    return WordTokens(path)


def encode_words(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, n_tokens, packed_ids (little-endian unsigned 32-bit integers), decoded.

    Ids are those of the tokenizers library without special tokens, truncation and padding; ``decoded`` is its
    ``decode(ids, skip_special_tokens=False)``. A null text is empty: no tokens, an empty decoded text. Whole texts of
    any length are encoded in time linear in their length; rows are judged one by one, so repeated, null and equal ids
    each give a row, and other columns of ``docs`` are not read. Strings of added tokens in a text get their own ids. A
    tokenizer that this does not encode exactly (dropout, an unknown token, a decoder) raises ``ValueError``.
    """
    id_type = docs.schema[id_col].dataType.simpleString()

    def encode(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = tokens_of(tokenizer_path)
        for batch in batches:
            texts = utf8(batch.column(1))
            for begin, stop in slices(texts, SLICE_BYTES):
                rows = [own.encode(t.decode("utf-8", "replace")) for t in texts[begin:stop]]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(begin, stop - begin), pa.array([len(r[0]) // 4 for r in rows], pa.int64()), pa.array([r[0] for r in rows], pa.binary()), pa.array([r[1] for r in rows], pa.string())],
                    ["doc_id", "n_tokens", "packed_ids", "decoded"],
                )

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(encode, f"doc_id {id_type}, n_tokens long, packed_ids binary, decoded string")
