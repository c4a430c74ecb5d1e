"""Reading a tokenizer file, and cutting texts into chunks that are encoded once each.

Almost all of a corpus is words seen before. A text is cut where the tokenizer cannot merge
across, at single white space between other characters; each distinct chunk is encoded once
per worker and kept in a bounded table, and a document is the concatenation of its chunks.
"""

from __future__ import annotations

import json
import os
import re
from array import array
from collections.abc import Callable, Iterable
from itertools import repeat
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

# Before white space between two other characters.
_JOINT = re.compile(r"(?<=\S)(?=[ \n]\S)")
_HEAD = "\x02"  # marks the first chunk of a text, which has no blank before it
_SPACE = r"\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
_UNSURE = rf"[{_SPACE}][ \n]|[{_SPACE}]$|\x02"
_MARKS = "!#$%&*,.:;?|"  # marks that end a word and take no part in any special token
# Letters of Latin scripts that stay one letter in lower case.
_LETTERS = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u024f"
_LATIN = re.compile(f"[{_LETTERS}]+")
# A chunk of one Latin word and marks after it, for Arrow's regular expressions.
_SIMPLE = f"(?P<word>[{_LETTERS}]+)(?P<marks>[{_MARKS}]*)$"
KEPT_CHUNKS = 700_000  # chunks a worker remembers, some 150 MB
KEPT_WORDS = 200_000  # words a worker remembers, some 35 MB, and those of one batch
WORDS_A_CALL = 500


def default_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def byte_letters() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies.

    Printable bytes of Latin-1 stand for themselves, all others follow from code point 256.
    """
    spare = iter(range(256, 512))
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


class Vocabulary:
    """A byte-level BPE vocabulary in the JSON format of the tokenizers library.

    The library cuts a text into words (its normalizer and pre-tokenizer); merging, encoding
    and decoding are done by the operators. Truncation and padding of the file are not used.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model = spec["model"]
        unused = ("dropout", "unk_token", "continuing_subword_prefix", "byte_fallback", "ignore_merges")
        if model["type"] != "BPE" or any(model.get(k) for k in unused):
            raise ValueError(f"{path} is not a plain BPE vocabulary")
        kinds = json.dumps(spec["pre_tokenizer"])
        if '"ByteLevel"' not in kinds or '"add_prefix_space": true' in kinds:
            raise ValueError(f"{path} is not a byte-level vocabulary without prefix space")
        if (spec["decoder"] or {"type": "ByteLevel"})["type"] != "ByteLevel":
            raise ValueError(f"{path} has a decoder that is not known here")
        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.ids: dict[str, int] = model["vocab"]
        self.suffix: str = model.get("end_of_word_suffix") or ""
        self.ranks: dict[tuple[str, str], int] = {}
        for rank, merge in enumerate(model["merges"]):
            pair = tuple(merge.split(" ")) if isinstance(merge, str) else tuple(merge)
            self.ranks[pair] = rank
        self.added: dict[str, int] = {t["content"]: t["id"] for t in spec["added_tokens"]}
        if any(t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"] for t in spec["added_tokens"]):
            raise ValueError(f"{path} has added tokens with rules of their own")
        self.size = max([*self.ids.values(), *self.added.values()]) + 1
        # White space is dropped if the words are those a pattern matches, as letters or digits.
        pieces = (spec["pre_tokenizer"] or {}).get("pretokenizers", [])
        self.drops_space = any(p["type"] == "Split" and p["behavior"] == "Removed" for p in pieces)
        self.joins_plain = spec["decoder"] is None
        self.plain = self.drops_space or pieces == [] and spec["normalizer"] is None
        self._letters = dict(enumerate(byte_letters()))
        found = sorted(self.added, key=len, reverse=True)
        self._special = re.compile("(" + "|".join(map(re.escape, found)) + ")") if found else None

    def words(self, chunk: str) -> list[str]:
        """The words of a chunk in byte letters; an added token is one item as it stands.

        Words of Latin letters are cut here, as the patterns of such files do; all else is
        left to the library's normalizer and pre-tokenizer.
        """
        if self.plain and chunk:
            core = chunk.rstrip(_MARKS)
            marks = chunk[len(core) :]
            word = core[1:] if core[:1] == " " else core
            if word.isascii() and word.isalpha():
                core = word.lower() if self.drops_space else core if word is core else "\u0120" + word
                return [core, marks] if marks else [core]
            if _LATIN.fullmatch(word):
                return [self.in_letters(w) for w in (word.lower() if self.drops_space else core, marks) if w]
        parts = self._special.split(chunk) if self._special else [chunk]
        out: list[str] = []
        for i, part in enumerate(parts):
            if i % 2:
                out.append(part)
            elif part:
                if self.library.normalizer is not None:
                    part = self.library.normalizer.normalize_str(part)
                out += [w for w, _ in self.library.pre_tokenizer.pre_tokenize_str(part)]
        return out

    def in_letters(self, word: str) -> str:
        return word.encode().decode("latin-1").translate(self._letters)

    def symbols(self, word: str) -> list[str]:
        """The letters that merging starts from; the last one carries the word end."""
        letters = list(word)
        letters[-1] += self.suffix
        return letters

    def chunks(self, texts: pa.Array) -> pa.Array:
        """For each text the list of its chunks, to be encoded apart without change.

        A vocabulary that drops white space is cut at every blank and newline. Others are
        cut before a single blank or newline between two other characters, where a word
        always ends; `spelled` gives the text of such a chunk back.
        """
        texts = texts.cast(pa.large_string())
        if self.drops_space:
            return pc.split_pattern(pc.replace_substring(texts, "\n", " "), " ")
        unsure = pc.match_substring_regex(texts, _UNSURE)
        mark, none = pa.scalar(_HEAD, texts.type), pa.scalar("", texts.type)
        heads = pc.binary_join_element_wise(mark, texts, none)
        lists = pc.split_pattern(pc.replace_substring(heads, "\n", " \n"), " ")
        if not pc.any(unsure).as_py():
            return lists
        rest = pa.array([self._cut(t) for t in texts.filter(unsure).to_pylist()], lists.type)
        mixed = pa.concat_arrays([lists.filter(pc.invert(unsure)), rest])
        order = np.argsort(unsure.to_numpy(zero_copy_only=False), kind="stable")
        return mixed.take(pa.array(np.argsort(order, kind="stable")))

    def _cut(self, text: str) -> list[str]:
        first, *others = _JOINT.split(text)
        return [_HEAD + first, *[c if c[:2] == " " + _HEAD else c.removeprefix(" ") for c in others]]

    def spelled(self, chunk: str) -> str:
        """The text that a chunk stands for."""
        if self.drops_space:
            return chunk
        if chunk[:1] == _HEAD:
            return chunk[1:]
        return chunk if chunk[:1] in ("\n", " ") else " " + chunk


class Chunks:
    """A bounded table from chunk to what `encode` makes of a list of their spellings."""

    def __init__(
        self,
        vocabulary: Vocabulary,
        encode: Callable[[list[str]], Iterable],
        limit: int = KEPT_CHUNKS,
    ):
        self.vocabulary, self.encode, self.limit = vocabulary, encode, limit
        self.known: dict[str, object] = {}

    def of(self, texts: pa.Array) -> tuple[list, np.ndarray, np.ndarray]:
        """(items, places, ends): the items of the distinct chunks, the place among them of
        each chunk of the texts in order, and the number of chunks up to each text's end."""
        lists = self.vocabulary.chunks(texts)
        coded = lists.flatten().dictionary_encode()
        distinct = coded.dictionary.to_pylist()
        new = [c for c in distinct if c not in self.known]
        if len(self.known) + len(new) > self.limit:
            self.known.clear()
            new = distinct
        spelled = self.vocabulary.spelled
        self.known.update(zip(new, self.encode([spelled(c) for c in new])))
        items = list(map(self.known.__getitem__, distinct))
        ends = np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False))
        return items, coded.indices.to_numpy(), ends


class Runs(NamedTuple):
    """Runs of ids, end to end."""

    ids: np.ndarray
    sizes: np.ndarray

    def at(self, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the runs at these places, and the number of ids up to the end of each."""
        total = int(self.sizes[places].sum()) + len(self.ids)
        kind = np.int32 if total < 1 << 31 else np.int64  # places of this batch: half the memory
        sizes = self.sizes.astype(kind)
        starts = np.cumsum(sizes, dtype=kind) - sizes
        each = sizes[places]
        upto = np.cumsum(each, dtype=kind)
        take = np.repeat(starts[places] - (upto - each), each)
        take += np.arange(len(take), dtype=kind)
        return self.ids[take], upto


def laid_out(items: Runs | list[bytes], places: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All ids of a batch in order, from the ids of its chunks, as runs or bytes, and each text's end."""
    if not isinstance(items, Runs):
        sizes = np.fromiter(map(len, items), np.int64, len(items)) // 4
        items = Runs(np.frombuffer(b"".join(items), "<u4"), sizes)
    ids, upto = items.at(places)
    return ids, np.concatenate([[0], upto])[ends]


class Words:
    """A bounded table from word to its ids, which the library merges.

    A chunk of one Latin word is looked up without the marks after it and the newline before
    it, so that a word is merged once whatever stands around it; any other chunk is looked up
    as it is. A full table keeps the half of its words that were in the most batches.
    """

    def __init__(self, vocabulary: Vocabulary, limit: int = KEPT_WORDS):
        from tokenizers import Tokenizer, pre_tokenizers

        self.vocabulary, self.limit = vocabulary, limit
        # Words in byte letters hold no blank: joined by blanks, hundreds are one call.
        self.merger = Tokenizer(vocabulary.library.model)
        self.merger.pre_tokenizer = pre_tokenizers.CharDelimiterSplit(" ")
        self.letters = np.zeros(vocabulary.size, np.int64)  # letters that each id stands for
        for token, i in vocabulary.ids.items():
            self.letters[i] = len(token.removesuffix(vocabulary.suffix))
        # The blank before a word is a letter of it; words after a head have none.
        self.head, self.blank = ("", "") if vocabulary.drops_space else (_HEAD, "\u0120")
        self.simple = f"^(?P<before>{'' if vocabulary.drops_space else f'[{_HEAD}\n]?'}){_SIMPLE}"
        if not vocabulary.plain:
            self.simple = r"(?P<before>)(?P<word>)(?P<marks>)[^\x00-\x{10ffff}]"  # matches nothing
        self.spelling = {**dict(enumerate(byte_letters())), ord(" "): " ", ord(_HEAD): _HEAD}
        self.known: dict[str | None, int] = {None: 0}  # None, without ids, is what is not there
        self.runs = Runs(np.zeros(0, np.uint32), np.zeros(1, np.int64))
        self.batches = np.zeros(1, np.int64)  # that each word was in

    def of(self, texts: pa.Array) -> tuple[Runs, np.ndarray, np.ndarray]:
        """(runs, places, ends): the ids of the distinct chunks, the place among them of
        each chunk of the texts in order, and the number of chunks up to each text's end."""
        lists = self.vocabulary.chunks(texts)
        coded = lists.flatten().dictionary_encode()
        ends = np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False))
        del lists  # of all memory here the most
        return self._encoded(coded.dictionary), coded.indices.to_numpy(), ends

    def _encoded(self, chunks: pa.Array) -> Runs:
        if len(self.known) > self.limit:
            self._forget()
        parts = pc.extract_regex(chunks, self.simple)
        simple = parts.is_valid()
        before, word, marks = parts.filter(simple).flatten()
        simple = simple.to_numpy(zero_copy_only=False)
        if self.vocabulary.drops_space:
            words = pc.utf8_lower(word).dictionary_encode()
        else:
            heads = pc.replace_substring(before, "\n", _HEAD)
            words = pc.binary_join_element_wise(heads, word, pa.scalar("", word.type)).dictionary_encode()
        marks = marks.dictionary_encode()
        ends = [self.head + m if m else None for m in marks.dictionary.to_pylist()]
        places = np.zeros((len(chunks), 3), np.int64)
        newline = self._places(["\n"], self._others)
        places[simple, 0] = np.where(pc.equal(before, "\n").to_numpy(zero_copy_only=False), newline, 0)
        places[simple, 1] = self._places(_as_list(words.dictionary), self._merged)[words.indices.to_numpy()]
        places[simple, 2] = self._places(ends, self._merged)[marks.indices.to_numpy()]
        others = chunks.filter(pa.array(~simple)).to_pylist()
        places[~simple, 1] = self._places(others, self._others)
        ids, _ = self.runs.at(places.reshape(-1))
        return Runs(ids, self.runs.sizes[places].sum(axis=1))

    def _places(self, keys: list, encode: Callable[[list[str]], Runs]) -> np.ndarray:
        """The places of distinct keys in the table, where those not known are put first."""
        found = np.fromiter(map(self.known.get, keys, repeat(-1)), np.int64, len(keys))
        new = np.flatnonzero(found < 0)
        if len(new):
            fresh = [keys[i] for i in new.tolist()]
            made = encode(fresh)
            places = range(len(self.known), len(self.known) + len(fresh))
            self.known.update(zip(fresh, places))
            found[new] = places
            self.runs = Runs(*map(np.concatenate, zip(self.runs, made)))
            self.batches = np.append(self.batches, np.zeros(len(fresh), np.int64))
        self.batches[found] += 1
        return found

    def _forget(self) -> None:
        self.batches[0] = np.iinfo(np.int64).max  # what is not there stays
        kept = np.sort(np.argsort(-self.batches, kind="stable")[: max(1, self.limit // 2)])
        keys = list(self.known)
        self.known = {keys[i]: place for place, i in enumerate(kept.tolist())}
        self.runs = Runs(self.runs.at(kept)[0], self.runs.sizes[kept])
        self.batches = self.batches[kept] // 2  # later batches count more

    def _merged(self, keys: list[str]) -> Runs:
        """The ids of Latin words and marks."""
        text = " ".join(keys)
        if not text.isascii():
            text = text.encode().decode("latin-1").translate(self.spelling)
        if self.blank:
            text = (self.blank + text.replace(" ", " " + self.blank)).replace(self.blank + _HEAD, "")
        return self._of_letters(text.split(" "))

    def _of_letters(self, words: list[str]) -> Runs:
        """The ids of words in byte letters."""
        calls = [" ".join(words[i : i + WORDS_A_CALL]) for i in range(0, len(words), WORDS_A_CALL)]
        ids = array("I")
        for line in self.merger.encode_batch_fast(calls, add_special_tokens=False):
            ids.extend(line.ids)
        flat = np.frombuffer(ids, np.uint32)
        upto = np.concatenate([[0], np.cumsum(self.letters[flat])])
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        return Runs(flat, np.diff(np.searchsorted(upto, np.cumsum(lengths)), prepend=0))

    def _others(self, chunks: list[str]) -> Runs:
        """The ids of chunks of any kind."""
        vocabulary = self.vocabulary
        words, counts, special = [], [], {}
        for i, text in enumerate(map(vocabulary.spelled, chunks)):
            found = vocabulary.words(text)
            if any(w in vocabulary.added for w in found):
                special[i], found = vocabulary.library.encode(text, add_special_tokens=False).ids, []
            words += found
            counts.append(len(found))
        runs = self._of_letters(words)
        sizes = np.bincount(np.repeat(np.arange(len(counts)), counts), runs.sizes, len(counts)).astype(np.int64)
        if not special:
            return Runs(runs.ids, sizes)
        ends = np.cumsum(sizes)
        ids = [np.array(special[i], np.uint32) if i in special else runs.ids[e - n : e] for i, (e, n) in enumerate(zip(ends, sizes))]
        return Runs(np.concatenate(ids), np.array([len(x) for x in ids], np.int64))


def _as_list(words: pa.Array) -> list[str]:
    """Words without blanks; much faster than `to_pylist`."""
    if not len(words):
        return []
    line = pc.binary_join(pa.ListArray.from_arrays([0, len(words)], words), pa.scalar(" ", words.type))
    return line[0].as_py().split(" ")


_LOADED: dict[tuple, object] = {}


def loaded(key: tuple, make: Callable[[], object]):
    """One object per worker process, made when first asked for."""
    if key not in _LOADED:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        _LOADED[key] = make()
    return _LOADED[key]


def library_chunks(path: str) -> Words:
    """Chunks encoded by the library, as runs of unsigned 32-bit ids."""

    def make() -> Words:
        vocabulary = Vocabulary(path)
        vocabulary.ranks = {}  # the library merges
        return Words(vocabulary)

    return loaded(("library", path), make)
