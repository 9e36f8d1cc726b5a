"""Whole texts as token ids by the tokenizer libraries.

Where no token can hold white space a text is encoded a word at a time. Words occur again and again: their ids are remembered, and those that
are not known yet are encoded by the library together.

Models that merge by ranks are given to tiktoken, where its merges are theirs: ids
then come as arrays, and their bytes are those of the text. Other texts go to the
library of the model.
"""

import json
import os
import re
import unicodedata
from array import array
from collections.abc import Callable

import numpy as np

from editwake.llm.common import MEMO_KEY, held

MARK = "▁"  # stands for a space inside pieces
PARTS = 150_000  # parts of texts that a worker remembers, besides as many older ones
WORDS = re.compile(r"[^ \t\n\r]+")
# All but Latin letters and common signs, which have one form and one lower case each.
FORMS = re.compile("[^\x00-\u012f\u0131-\u024f\u2010-\u2027]")
END = b"\xff"  # in no text
LONG_RUN = re.compile(r"[^ ]{2000}|\s{2000}")  # in which merging by ranks is slow
# The fixed pattern that byte-level models cut texts by.
BYTE_LEVEL = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


class PartEncoder:
    """Packed little-endian 32-bit ids of a text.

    ``cut`` divides a text into parts, ``encode`` gives the packed ids of a list of
    parts. At most ``entries`` parts and as many older ones are remembered.
    """

    def __init__(self, cut: Callable[[str], list[str]], encode: Callable, entries: int = PARTS):
        self.cut, self.encode, self.entries = cut, encode, entries
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def _fill(self, parts: set[str]) -> dict[str, bytes]:
        """What is not among the known parts; short ones are known from now on."""
        found = {p: self.older[p] for p in parts if p in self.older}
        new = [p for p in parts if p not in found]
        for part, ids in zip(new, self.encode(new)):
            found[part] = ids
        if len(self.known) >= self.entries:
            self.older, self.known = self.known, {}
        self.known.update((p, ids) for p, ids in found.items() if len(p) <= MEMO_KEY)
        return found

    def __call__(self, text: str) -> bytes:
        parts = self.cut(text)
        ids = [*map(self.known.get, parts)]
        if None in ids:
            known = self._fill({p for p, i in zip(parts, ids) if i is None})
            ids = [known[p] if i is None else i for p, i in zip(parts, ids)]
        return b"".join(ids)


def library(model: str, plain: bool = False) -> Callable[[list[str]], list[list[int]]]:
    """Encoding by the tokenizers library; with ``plain`` special tokens in a text are ordinary text."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    found = Tokenizer.from_str(model)
    found.encode_special_tokens = plain

    def encode(parts: list[str]) -> list[list[int]]:
        return [e.ids for e in found.encode_batch_fast(parts, add_special_tokens=False)]

    return encode


def byte_of_char() -> dict[str, int]:
    """The characters that stand for bytes in byte-level vocabularies: visible ones for themselves."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class Words:
    """Packed ids of words by a model that drops white space and marks the ends of words.

    Texts and words of Latin letters, digits and signs are merged by ranks: the mark is a
    byte that no text has, which joins the byte before it first of all. All other
    words, special tokens among them, go to the tokenizers library.
    """

    def __init__(self, model: str):
        import tiktoken

        rules = json.loads(model)
        self.library = library(model)
        of_char, mark = byte_of_char(), rules["model"]["end_of_word_suffix"] or "</w>"
        vocabulary = rules["model"]["vocab"]
        tokens = [(bytes([b]), c) for c, b in of_char.items()]
        tokens += [(bytes([b, *END]), c + mark) for c, b in of_char.items()]
        for pair in rules["model"]["merges"]:
            token = "".join(pair if isinstance(pair, list) else pair.split(" "))
            end = token.endswith(mark)
            tokens.append((bytes(of_char[c] for c in token.removesuffix(mark)) + END * end, token))
        ranks = {raw: rank for rank, (raw, _) in enumerate(tokens) if raw != END + END}
        self.packed = [vocabulary.get(token, 0).to_bytes(4, "little") for _, token in tokens]
        coder = tiktoken.Encoding("words", pat_str=".", mergeable_ranks=ranks, special_tokens={})
        self.merged = coder._core_bpe.encode_single_piece
        self.cut = re.compile(_of_plain(_pattern(rules) or "")).findall
        self.name = re.compile("|".join(re.escape(t["content"]) for t in rules["added_tokens"]) or "(?!)")
        self.plain = len(ranks) == len(tokens) - 1 and all(token in vocabulary for _, token in tokens)

    def simple(self, text: str) -> bool:
        """Whether neither the forms of its characters nor special tokens matter to a text."""
        return not FORMS.search(text) and not self.name.search(text)

    def parts(self, text: str) -> list[str]:
        """Parts that are encoded alone: what the model takes for words, or what lies between spaces."""
        return self.cut(text.lower()) if self.simple(text) else WORDS.findall(text)

    def __call__(self, words: list[str]) -> list[bytes]:
        packed, out, odd = self.packed, [], []
        for at, word in enumerate(words):
            if word.isascii() and word.isalpha():
                pieces = (word.lower(),)
            elif self.simple(word):
                pieces = self.cut(word.lower())
            else:
                odd.append(at)
                pieces = ()
            out.append(b"".join([packed[r] for p in pieces for r in self.merged(p.encode() + END)]))
        for at, ids in zip(odd, self.library([words[i] for i in odd]) if odd else ()):
            out[at] = array("I", ids).tobytes()
        return out


def _of_plain(pattern: str) -> str:
    """A pattern of kinds of characters, spelt out for the characters of plain texts."""
    plain = [chr(c) for c in (*range(0x250), *range(0x2010, 0x2028))]
    kinds = {k: [re.escape(c) for c in plain if unicodedata.category(c)[0] == k] for k in "LN"}
    spaces = [re.escape(c) for c in plain if c in "\t\n\x0b\x0c\r\x85" or unicodedata.category(c) == "Zs"]
    for name, kind in (*((rf"\p{{{k}}}", v) for k, v in kinds.items()), (r"\s", spaces)):
        pattern = pattern.replace(name, "".join(kind))
    return pattern


def _pattern(rules: dict) -> str | None:
    """What a model takes for words, if it composes characters, lowers their case and drops white space."""
    steps = (rules["pre_tokenizer"] or {}).get("pretokenizers", [])
    first = steps[0] if steps else {}
    pattern = first.get("pattern", {}).get("Regex", "")
    forms = [n["type"] for n in (rules["normalizer"] or {}).get("normalizers", [])]
    fits = (
        (first.get("type"), first.get("behavior"), first.get("invert")) == ("Split", "Removed", True)
        and [s["type"] for s in steps[1:]] == ["ByteLevel"]
        and not steps[1]["add_prefix_space"]
        and not steps[1]["use_regex"]
        and forms == ["NFC", "Replace", "Lowercase"]
        and pattern.endswith(r"[^\s\p{L}\p{N}]+")
        and " " not in pattern
    )
    return pattern if fits else None


def word_encoder(model: str) -> PartEncoder:
    """For a model of the tokenizers library, as text, whose tokens never hold white space.

    Such a model's words are encoded alone; others are given whole texts.
    """

    def build() -> PartEncoder:
        known = Words(model) if _pattern(json.loads(model)) else None
        if known is not None and known.plain:
            return PartEncoder(known.parts, known)
        general = library(model)
        cut = WORDS.findall if known is not None else lambda text: [text] if text else []
        return PartEncoder(cut, lambda parts: [array("I", ids).tobytes() for ids in general(parts)])

    return held(("words", model), build)


def _ranked(ranks: dict[bytes, int], pattern: str) -> Callable[[str], np.ndarray]:
    """Merging of whole texts by ranks, inside the matches of a pattern."""
    import tiktoken

    coder = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    return lambda text: coder.encode_to_numpy(text, disallowed_special=())


def _byte_level(rules: dict, vocabulary: dict[str, int], surface: list[bytes]) -> Callable[[str], np.ndarray] | None:
    """A byte-level model merged by ranks, if its ids are in the order of its merges, as ranks are."""
    merges = rules["model"]["merges"]
    joined = ["".join(m if isinstance(m, list) else m.split(" ")) for m in merges]
    steps = rules["pre_tokenizer"] or {}
    plain = [t["id"] for t in rules["added_tokens"]]
    if (
        [vocabulary[t] for t in joined] != [*range(256, 256 + len(joined))]
        or steps.get("type") != "ByteLevel"
        or not steps.get("use_regex", True)
        or steps["add_prefix_space"]
        or rules["normalizer"] is not None
    ):
        return None
    return _ranked({s: i for i, s in enumerate(surface) if i not in plain}, BYTE_LEVEL)


def _merged_pieces(proto, pieces) -> Callable[[str], np.ndarray] | None:
    """A piece model merged by ranks: those of its scores, after the characters have been made of their bytes.

    For texts without marks. Runs of spaces are pieces of one score, the last of all; the
    library joins them from the left, as is done if a longer run ranks before a shorter one.
    The first bytes of characters rank too; where they stay, the character has no piece
    and is spelt in bytes. None if the model does other than merge what is written,
    if the order of merges or the cuts are not sure, or if a piece is not its own encoding.
    """
    form, trained = proto.normalizer_spec, proto.trainer_spec
    name = [p.piece.replace(MARK, " ") for p in proto.pieces]
    of_byte = {int(p.piece[1:-1], 16): i for i, p in enumerate(proto.pieces) if p.type == p.BYTE}
    normal = [i for i, p in enumerate(proto.pieces) if p.type == p.NORMAL]
    longer = [i for i in normal if len(name[i]) > 1]
    strict = [i for i in longer if name[i].strip(" ")]
    runs = sorted((i for i in longer if not name[i].strip(" ")), key=lambda i: -len(name[i]))
    if (
        trained.model_type != trained.BPE
        or trained.treat_whitespace_as_suffix
        or form.precompiled_charsmap
        or form.remove_extra_whitespaces
        or not (form.add_dummy_prefix and form.escape_whitespaces)
        or len(of_byte) < 256
        or any(p.type in (p.USER_DEFINED, p.UNUSED) for p in proto.pieces)
        or len({proto.pieces[i].score for i in strict}) < len(strict)
        or any(" " in name[i][1:] or "\n" in name[i] for i in strict)
        or len({proto.pieces[i].score for i in runs}) > 1
        or any(proto.pieces[i].score >= min(proto.pieces[j].score for j in strict) for i in runs[:1])
    ):
        return None
    # A match of the pattern that is a piece is given as it is.
    if pieces.encode([name[i][1:] for i in strict if name[i][0] == " "], num_threads=1) != [[i] for i in strict if name[i][0] == " "]:
        return None

    of_char = {name[i]: i for i in normal if len(name[i]) == 1}
    ranks = {bytes([b]): b for b in range(256)}
    spelt = [[of_char.get(chr(b), of_byte[b]) if b < 128 else of_byte[b]] for b in range(256)]

    def add(raw: bytes, ids: list[int]) -> None:
        if raw not in ranks:
            ranks[raw] = len(spelt)
            spelt.append(ids)

    for char, i in of_char.items():
        raw = char.encode()
        for size in range(2, len(raw)):
            add(raw[:size], [of_byte[b] for b in raw[:size]])
        add(raw, [i])
    for i in [*sorted(strict, key=lambda i: -proto.pieces[i].score), *runs]:
        add(name[i].encode(), [i])
    # The ids of each rank, one as a rule, the rest of the row being -1.
    rows = np.array([ids + [-1] * (3 - len(ids)) for ids in spelt], dtype=np.int32)
    one = np.where(rows[:, 1] < 0, rows[:, 0], -1)
    merged = _ranked(ranks, r" *[^ \n]+| +|\n")

    def encode(text: str) -> np.ndarray:
        found = merged(text)
        ids = one.take(found)
        if ids.size and ids.min() < 0:
            ids = rows[found].ravel()
            ids = ids[ids >= 0]
        return ids

    spaces = [" " * n for n in range(2, 3 * max([1, *(len(name[i]) for i in runs)]) + 1)]
    return encode if [encode(s).tolist() for s in spaces] == pieces.encode([s[1:] for s in spaces], num_threads=1) else None


class BytePieces:
    """Two encoders of a space and a text, byte-level and by pieces, and the bytes of their ids.

    Special tokens of the first are ordinary text.
    """

    def __init__(self, byte_model: str, piece_model: bytes):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2

        rules = json.loads(byte_model)
        vocabulary = rules["model"]["vocab"] | {t["content"]: t["id"] for t in rules["added_tokens"]}
        of_char = byte_of_char()
        self.byte_surface = [b""] * (max(vocabulary.values()) + 1)
        for token, i in vocabulary.items():
            self.byte_surface[i] = bytes(of_char.get(c, 0x3F) for c in token)
        self.byte_library = library(byte_model, plain=True)
        self.bytes_ranked = _byte_level(rules, vocabulary, self.byte_surface)

        proto = sentencepiece_model_pb2.ModelProto()
        proto.ParseFromString(piece_model)
        self.piece_surface = [
            bytes([int(p.piece[1:-1], 16)]) if p.type == p.BYTE else p.piece.replace(MARK, " ").encode()
            for p in proto.pieces
        ]
        self.pieces = sentencepiece.SentencePieceProcessor(model_proto=piece_model)
        self.pieces_ranked = _merged_pieces(proto, self.pieces)

    def _byte_ids(self, text: str, short: bool) -> tuple[np.ndarray, bool]:
        if short and self.bytes_ranked:
            return self.bytes_ranked(text), True
        return np.array(self.byte_library([text])[0], dtype=np.int32), False

    def _piece_ids(self, text: str, short: bool) -> tuple[np.ndarray, bool]:
        if short and self.pieces_ranked and MARK not in text:
            return self.pieces_ranked(text), True
        # The model adds the space at the start itself.
        return np.array(self.pieces.encode(text[1:], num_threads=1), dtype=np.int32), False

    def byte_ids(self, text: str) -> list[int]:
        return self._byte_ids(text, not LONG_RUN.search(text))[0].tolist()

    def piece_ids(self, text: str) -> list[int]:
        return self._piece_ids(text, not LONG_RUN.search(text))[0].tolist()

    def ids(self, text: str) -> list[np.ndarray] | None:
        """The ids of a text that starts with a space by both encoders, or None if the bytes of either are others.

        What is merged by ranks has the bytes of the text; what the libraries give is compared.
        """
        short, out = not LONG_RUN.search(text), []
        for encode, surface in ((self._byte_ids, self.byte_surface), (self._piece_ids, self.piece_surface)):
            ids, sure = encode(text, short)
            if not sure and b"".join(map(surface.__getitem__, ids.tolist())) != text.encode():
                return None
            out.append(ids)
        return out


def byte_pieces(byte_model: str, piece_model: bytes) -> BytePieces:
    """Both models, built once in each worker."""
    return held(("byte-pieces", byte_model, piece_model), lambda: BytePieces(byte_model, piece_model))
