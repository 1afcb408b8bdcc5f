"""Token ids of whole texts by a public vocabulary, each distinct run of letters or signs encoded once per worker."""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterable, Iterator

from .hashing import segments

#: End id of a document.
END_ID = 1
#: Bytes of texts joined at once, and distinct pieces (and parts of them) remembered by a worker before it starts anew.
CHUNK_BYTES, CACHE_PIECES = 2 << 20, 600_000

#: What every blank of ASCII becomes before a text is cut at it.
_BLANKS = bytes.maketrans(b"\t\n\v\f\r", b" " * 5)
#: Pieces of these letters, digits and signs alone are parted here: no apostrophe (contractions), no "<" (special tokens),
#: no letter that NFC or lower case change otherwise than one for one.
_PLAIN, _PARTS = re.compile("[!-&(-;=-~À-ÖØ-öø-ÿ]*"), re.compile("[a-zß-öø-ÿ]+|[0-9]| |[^a-z0-9ß-öø-ÿ ]+")
#: The rules of a vocabulary by which that holds.
_NORMAL = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]
_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _rules(component) -> list[dict]:
    """The steps of a normalizer or pre-tokenizer."""
    told = json.loads(component.__getstate__()) if component else {}
    return told.get("normalizers") or told.get("pretokenizers") or [told]


class _Known:
    """Ids of distinct strings, one after the other; a string has a number, by which they are found."""

    def __init__(self):
        import numpy as np

        self.index: dict[str, int] = {}
        self.starts, self.sizes, self.flat = (np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int32), np.zeros(1 << 18, np.uint32))
        self.used = 0

    def add(self, names: list[str], sizes, ids) -> None:
        import numpy as np

        k = len(self.index)
        while k + len(names) > len(self.starts):
            self.starts, self.sizes = (np.concatenate([x, np.zeros_like(x)]) for x in (self.starts, self.sizes))
        while self.used + len(ids) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        self.flat[self.used : self.used + len(ids)] = ids
        self.sizes[k : k + len(names)] = sizes
        self.starts[k : k + len(names)] = self.used + np.cumsum(sizes) - sizes
        self.index.update(zip(names, range(k, k + len(names)), strict=True))
        self.used += len(ids)

    def ids(self, at) -> tuple:
        """(ids of the strings with these numbers, where each one's end)."""
        import numpy as np

        sizes = self.sizes[at].astype(np.int64)
        ends = np.cumsum(sizes)
        return self.flat[np.repeat(self.starts[at] - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0)], ends


class PieceEncoder:
    """ids of texts, as Tokenizer.encode(text, add_special_tokens=False) gives them.

    The vocabulary drops white space before it pairs letters, so no id spans a blank or a line end: a text's ids
    are those of the pieces between them, one after the other. It also lower-cases letters and pairs none across runs
    of letters, single digits and runs of signs, so a plain piece has the ids of these parts, which are far fewer and go to
    the vocabulary's model without its rules. Other pieces, and all of them under other rules, are encoded whole. Each
    piece and part is encoded once and then found; of a chunk of texts only the distinct pieces are looked up.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.model = Tokenizer(self.tokenizer.model)
        self.model.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.CharDelimiterSplit(" "), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        first, *rest = _rules(self.tokenizer.pre_tokenizer)
        self.parted = (
            _rules(self.tokenizer.normalizer) == _NORMAL
            and first == {"type": "Split", "pattern": {"Regex": _SPLIT}, "behavior": "Removed", "invert": True}
            and [(x["type"], x["add_prefix_space"], x["use_regex"]) for x in rest] == [("ByteLevel", False, False)]
            and all("<" in x.content for x in self.tokenizer.get_added_tokens_decoder().values())
        )
        self.pieces, self.parts = _Known(), _Known()

    def _learn(self, pieces: list[str]) -> None:
        """Encode new pieces."""
        import numpy as np

        plain = [self.parted and _PLAIN.fullmatch(x) is not None for x in pieces]
        whole, parted = [x for x, p in zip(pieces, plain, strict=True) if not p], [x for x, p in zip(pieces, plain, strict=True) if p]
        for group, found in self._grouped(self.tokenizer, whole):
            ends = np.cumsum([len(x) + 1 for x in group])
            owner = np.searchsorted(ends, np.array([x for x, _ in found.offsets], np.int64), "right")  # the piece in which an id's text begins
            self.pieces.add(group, np.bincount(owner, minlength=len(group)), found.ids)
        if not parted:
            return
        if len(self.parts.index) > CACHE_PIECES:
            self.parts = _Known()
        if not self.parts.index:
            self.parts.add([" "], [0], [])
        parts = _PARTS.findall(" ".join(parted).lower())
        for group, found in self._grouped(self.model, list(dict.fromkeys(x for x in parts if x not in self.parts.index))):
            self.parts.add(group, np.bincount(np.array(found.word_ids, np.int64), minlength=len(group)), found.ids)
        at = np.fromiter(map(self.parts.index.__getitem__, parts), np.int64, len(parts))
        ids, ends = self.parts.ids(at)
        self.pieces.add(parted, np.diff(np.append(ends[at == 0], len(ids)), prepend=0), ids)  # a blank, number 0, ends a piece

    def _grouped(self, tokenizer, names: list[str]) -> Iterator[tuple]:
        """(names, their encoding), 200 joined by blanks at a time."""
        groups = [names[i : i + 200] for i in range(0, len(names), 200)]
        return zip(groups, tokenizer.encode_batch([" ".join(g) for g in groups], add_special_tokens=False), strict=True)

    def encode(self, texts: Iterable[str | None]) -> Iterator:
        """One uint32 array per text; a null text is empty."""
        import numpy as np

        chunk, size = [], 0
        for t in texts:
            data = (t or "").encode()
            if len(data) > CHUNK_BYTES:
                yield from self._encode(chunk)
                chunk, size = [], 0
                yield np.concatenate([ids for part in segments(data, CHUNK_BYTES) for ids in self._encode([part])])
                continue
            chunk.append(data)
            size += len(data)
            if size >= CHUNK_BYTES:
                yield from self._encode(chunk)
                chunk, size = [], 0
        yield from self._encode(chunk)

    def _encode(self, texts: list[bytes]) -> Iterator:
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        if not texts:
            return
        if len(self.pieces.index) > CACHE_PIECES:
            self.pieces = _Known()
        cut = pc.split_pattern(pa.array([t.translate(_BLANKS) for t in texts], pa.binary()), " ")
        named = cut.flatten().dictionary_encode()
        distinct = pc.binary_join(pa.ListArray.from_arrays([0, len(named.dictionary)], named.dictionary), b" ")[0].as_py().decode().split(" ")
        found = list(map(self.pieces.index.get, distinct))
        if None in found:
            self._learn([x for x, i in zip(distinct, found, strict=True) if i is None])
            found = list(map(self.pieces.index.get, distinct))
        ids, ends = self.pieces.ids(np.array(found, np.int64)[named.indices.to_numpy()])
        begin = 0
        for stop in ends[cut.offsets.to_numpy()[1:] - 1].tolist():
            yield ids[begin:stop]
            begin = stop


_ENCODERS: dict[str, PieceEncoder] = {}


def encoder(path: str) -> PieceEncoder:
    """The worker's encoder, kept while the worker lives."""
    if path not in _ENCODERS:
        _ENCODERS[path] = PieceEncoder(path)
    return _ENCODERS[path]


def with_end(ids, end_id: int = END_ID):
    import numpy as np

    return np.append(ids, np.uint32(end_id)).astype("<u4")
