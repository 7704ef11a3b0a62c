"""BPE encoding and decoding with forced boundaries.

A byte pair that no vocabulary token holds can never end up inside one token, so
merges on its two sides cannot meet: every pre-token is cut there, the fragments
are encoded on their own (and kept, as the same fragments come back again and
again), and their ids are joined. The normaliser and the pre-tokeniser are those
of the tokenizer file, written out over ``regex``; a text with letters whose class
or form differs between ``regex``, Python and the library goes through the
library's own parts. A file of any other make is refused.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from ._store import col, small_batches, with_row
from ._text import batches, slices

#: Words that a worker keeps with their ids; beyond it, it starts anew.
KEPT_WORDS = 150_000

# The normaliser and the pre-token pattern of the tokenizer file.
NORMALIZERS = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
PRE_TOKENIZERS = [
    {"type": "Split", "pattern": {"Regex": PATTERN}, "behavior": "Removed", "invert": True},
    {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
]
MODEL = {"type": "BPE", "dropout": None, "unk_token": None, "continuing_subword_prefix": None, "fuse_unk": False, "byte_fallback": False, "ignore_merges": False}
#: The same pattern for ``regex``; white space is Unicode's property.
_WORD = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\p{White_Space}\p{L}\p{N}]+")


def byte_letters() -> list[str]:
    """The printable stand-in of each byte: itself where it prints in Latin-1, else the next free code from 256 on."""
    own = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    free = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(free)) for b in range(256)]


def refuse_others(d: dict) -> None:
    """Raises ValueError for a file whose parts are not those that are written out here."""
    parts = {"normalizer": ("normalizers", NORMALIZERS), "pre_tokenizer": ("pretokenizers", PRE_TOKENIZERS)}
    for name, (inner, own) in parts.items():
        if d.get(name) != {"type": "Sequence", inner: own}:
            raise ValueError(f"{name} of the tokenizer file is not the one written out here")
    if d.get("decoder") or d.get("post_processor") or any(d["model"].get(k) != v for k, v in MODEL.items()):
        raise ValueError("model, decoder or post-processor of the tokenizer file is not the one written out here")
    if any(t[flag] for t in d["added_tokens"] for flag in ("single_word", "lstrip", "rstrip", "normalized")):
        raise ValueError("added tokens with flags are not written out here")


def _normal(text: str) -> str:
    """NFC and lower case, letter by letter: a final sigma is an ordinary one. White space is cut at anyway."""
    if not text.isascii():
        text = unicodedata.normalize("NFC", text).replace("Σ", "σ")
    return text.lower()


def differing_letters() -> list[tuple[int, int]]:
    """Runs of code points that Python, ``regex`` and the library do not take for the same: found once, on the driver.

    Letters new to one of the three are all that can combine in other ways, so single
    letters, and marks next to a mark of a lower and of a higher class, are compared.
    """
    from tokenizers import Regex, normalizers, pre_tokenizers

    form = normalizers.Sequence([normalizers.NFC(), normalizers.Lowercase()])
    # unassigned and private letters go through the library anyway
    codes = [c for c in range(0x80, 0x110000) if not 0xD800 <= c < 0xE000]
    odd = {c for c in codes if unicodedata.category(chr(c)) in ("Cn", "Co")}
    known = [chr(c) for c in codes if c not in odd]
    marks = [c for c in known if unicodedata.category(c)[0] == "M"]
    for letters, frame in ((known, "a{}b"), (marks, "b\u0301{}b"), (marks, "b{}\u0338b")):
        for i in range(0, len(letters), 4096):
            put = [frame.format(c) for c in letters[i : i + 4096]]
            theirs = form.normalize_str("\0".join(put)).split("\0")
            odd.update(ord(c) for c, x, y in zip(letters[i : i + 4096], put, theirs, strict=True) if _normal(x) != y)
    for theirs, ours in ((r"\p{L}", r"\p{L}"), (r"\p{N}", r"\p{N}"), (r"\s", r"\p{White_Space}")):
        own = pre_tokenizers.Split(Regex(f"[{theirs}]+"), behavior="removed", invert=True)
        for i in range(0, len(known), 4096):
            part = "".join(known[i : i + 4096])
            odd.update(map(ord, set("".join(x for x, _ in own.pre_tokenize_str(part))) ^ set(regex.findall(ours, part))))
    runs: list[tuple[int, int]] = []
    for c in codes:
        if c in odd:
            if runs and runs[-1][1] == c - 1:
                runs[-1] = runs[-1][0], c
            else:
                runs.append((c, c))
    return runs


class LibraryWords:
    """Normaliser and pre-tokeniser of the library, for texts with letters of the given runs."""

    def __init__(self, runs: list[tuple[int, int]]):
        from tokenizers import Regex, normalizers, pre_tokenizers

        self.normalizer = normalizers.Sequence([normalizers.NFC(), normalizers.Replace(Regex(r"\s+"), " "), normalizers.Lowercase()])
        self.split = pre_tokenizers.Split(Regex(PATTERN), behavior="removed", invert=True)
        of = lambda part: "[" + "".join(f"{re.escape(chr(a))}-{re.escape(chr(b))}" for a, b in part) + "]"
        self.odd = re.compile(of(runs))
        # letters beyond the basic plane are few, and looked up only where there are any
        self.quick = re.compile(of([*((a, min(b, 0xFFFF)) for a, b in runs if a <= 0xFFFF), (0x10000, 0x10FFFF)]))

    def needed(self, text: str) -> bool:
        return not text.isascii() and bool(m := self.quick.search(text)) and bool(self.odd.search(text, m.start()))

    def words(self, text: str) -> list[str]:
        return [w for w, _ in self.split.pre_tokenize_str(self.normalizer.normalize_str(text))]


class Codec:
    """Encoder and decoder of one tokenizer file, given as its JSON; ``runs`` as differing_letters has them."""

    def __init__(self, spec: str, runs: list[tuple[int, int]] | None = None):
        from tokenizers import Tokenizer
        from tokenizers.models import BPE

        d = json.loads(spec)
        refuse_others(d)
        self.library = LibraryWords(differing_letters() if runs is None else runs)
        model, end = d["model"], d["model"]["end_of_word_suffix"] or ""
        vocab, merges = model["vocab"], [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self.special = {t["content"]: t["id"] for t in d["added_tokens"]}
        self.tokens = {i: t for t, i in vocab.items()} | {i: t for t, i in self.special.items()}
        self.cut_special = regex.compile("|".join(regex.escape(s) for s in sorted(self.special, key=len, reverse=True))) if self.special else None
        self.letters = byte_letters()
        bare = [t.removesuffix(end) if end else t for t in vocab]
        self.inside = {t[i : i + 2] for t in bare for i in range(len(t) - 1)}
        # the merges of a fragment: with the end mark for the last one of a word, without it for the others
        self.last = Tokenizer(BPE(vocab, merges, end_of_word_suffix=end or None))
        self.other = Tokenizer(BPE(vocab, merges))
        self.words: dict[str, bytes] = {}
        self.by_byte = dict(enumerate(self.letters))

    def split(self, text: str) -> list[str]:
        """Pre-tokens of a text without special tokens."""
        if self.library.needed(text):
            return self.library.words(text)
        return _WORD.findall(_normal(text))

    def pieces(self, text: str) -> list[str]:
        """Pre-tokens in order; special tokens stand for themselves."""
        if self.cut_special is None or not any(s in text for s in self.special):
            return self.split(text)
        out, at = [], 0
        for m in self.cut_special.finditer(text):
            out += self.split(text[at : m.start()])
            out.append(m.group())
            at = m.end()
        return out + self.split(text[at:])

    def fragments(self, word: str) -> list[str]:
        """A pre-token in byte letters, cut at every pair that no token holds."""
        w = word if word.isascii() and word.isprintable() else word.encode().decode("latin-1").translate(self.by_byte)
        inside, out, at = self.inside, [], 0
        for i in range(1, len(w)):
            if w[i - 1 : i + 1] not in inside:
                out.append(w[at:i])
                at = i
        out.append(w[at:])
        return out

    def _encode(self, tokenizer, parts: list[str]) -> dict[str, bytes]:
        if not parts:
            return {}
        e = tokenizer.encode(parts, is_pretokenized=True, add_special_tokens=False)
        ids, owner = np.array(e.ids, np.uint32), np.array([-1 if x is None else x for x in e.word_ids], np.int64)
        cut = np.searchsorted(owner, np.arange(len(parts) + 1))
        return {p: ids[cut[i] : cut[i + 1]].tobytes() for i, p in enumerate(parts)}

    def learn(self, words: set[str]) -> None:
        """Adds the ids of words that are not known yet, each distinct fragment encoded once."""
        if len(self.words) > KEPT_WORDS:
            self.words.clear()
        new = [w for w in words if w not in self.words]
        cuts = [self.fragments(w) if w not in self.special else None for w in new]
        last = self._encode(self.last, list({c[-1] for c in cuts if c}))
        other = self._encode(self.other, list({f for c in cuts if c for f in c[:-1]}))
        for w, c in zip(new, cuts, strict=True):
            self.words[w] = self.special[w].to_bytes(4, "little") if c is None else b"".join([other[f] for f in c[:-1]]) + last[c[-1]]

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as packed little-endian unsigned 32-bit integers."""
        split = [self.pieces(t) for t in texts]
        self.learn(set().union(*split))
        known = self.words
        return [b"".join([known[w] for w in s]) for s in split]

    def decode(self, ids: bytes) -> str:
        """Tokens joined by blanks, as a tokenizer file without a decoder has it; ids that are not in it are left out."""
        tokens = self.tokens
        return " ".join([tokens[i] for i in np.frombuffer(ids, "<u4").tolist() if i in tokens])


_codecs: dict[int, Codec] = {}


def codec(spec: str, runs: list[tuple[int, int]]) -> Codec:
    """One codec for each file and worker."""
    key = hash(spec)
    if key not in _codecs:
        _codecs.clear()
        _codecs[key] = Codec(spec, runs)
    return _codecs[key]


def bpe_round_trip(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encodes whole texts and decodes the ids again.

    One row per input row: ``row`` (a struct of all input columns), ``ids``
    (binary: little-endian unsigned 32-bit integers), ``n_tokens`` (long) and
    ``decoded`` (text). A null or empty text has no ids and decodes to an empty
    text. A very long text is encoded whole, as a slice of its own. Repeated rows,
    null ids and clashing column names change nothing; an empty table gives no rows.
    The file is read on the driver and sent once; its size is fixed by the vocabulary.
    """
    from pyspark.sql import functions as F

    spark = docs.sparkSession
    small_batches(spark)
    with open(tokenizer_path, encoding="utf-8") as f:
        spec = f.read()
    refuse_others(json.loads(spec))
    sent = spark.sparkContext.broadcast((spec, differing_letters()))

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(*sent.value)
        for b in batches(it):
            texts = b.column(1)
            for at, _, off in slices(texts):
                n = len(off) - 1
                ids = c.encode([t or "" for t in texts.slice(at, n).to_pylist()])
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(at, n), pa.array(ids, pa.binary()), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array([c.decode(x) for x in ids], pa.string())],
                    names=["row", "ids", "n_tokens", "decoded"],
                )

    packed = docs.select(F.struct(*[col(c) for c in docs.columns]).alias("row"), col(text_col).alias("text"))
    return packed.mapInArrow(run, with_row(packed, "ids binary, n_tokens long, decoded string"))
