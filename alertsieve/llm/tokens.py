"""Token ids of whole texts, as packed little-endian arrays.

``encode(texts)`` gives exactly ``Tokenizer.encode(text,
add_special_tokens=False).ids`` of the ``tokenizers`` library.  For byte-level
BPE files a text is cut before each space that follows a non-space character;
such a place always is a boundary between the tokenizer's own pieces, so the
ids of the segments, joined, are the ids of the text.  A batch's texts are
split and their distinct segments found in Arrow; only distinct segments are
looked up in a bounded per-worker cache, and the library encodes those that
are not there.  The cache has two generations: segments used again survive.
"""

from __future__ import annotations

import hashlib
import json
import re
import string
from codecs import charmap_decode
from itertools import chain, compress

import numpy as np
from pyspark.sql import SparkSession

#: Segments a worker remembers (about 150 bytes each).
CACHE_SEGMENTS = 500_000

_SPACES = r"\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
_CUT = re.compile(r"(?<!\s) ")
_SPACE_NO_LINE = re.compile(r"[^\S\n]")
#: The byte-level alphabet: printable bytes stand for themselves, the others for code points from 256 on.
_PRINTABLE = {*range(33, 127), *range(161, 173), *range(174, 256)}
_BYTE_LEVEL = "".join(chr(b if b in _PRINTABLE else 256 + sum(x not in _PRINTABLE for x in range(b))) for b in range(256))
#: ASCII marks that end a run of letters and are one piece together (an apostrophe may begin a piece of its own).
_MARKS = string.punctuation.replace("'", "")
_WORKER: dict[str, "Encoder"] = {}


class Encoder:
    def __init__(self, definition: str, cache_segments: int = CACHE_SEGMENTS):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(definition)
        self.dtype = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        spec = json.loads(definition)
        pre = spec.get("pre_tokenizer") or {}
        added = spec.get("added_tokens") or []
        self.added = [t["content"] for t in added]
        self.by_segment = (pre.get("type") == "ByteLevel" and pre.get("use_regex", True)
                           and not pre.get("add_prefix_space") and not spec.get("normalizer")
                           and not spec.get("truncation") and not spec.get("padding")
                           and not any(t.get("single_word") or t.get("lstrip") or t.get("rstrip") or re.search(r"\s", t["content"])
                                       for t in added))
        # letters, marks and line ends are single pieces, unless an added token could be among them
        self.by_piece = self.by_segment and not any(t.isalpha() or not t.strip(_MARKS) for t in self.added)
        self.limit = cache_segments
        # ids by segment without its leading space, and by piece without one
        self.recent: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.pieces: dict[str, bytes] = {}

    def _library(self, parts: list[str]) -> list[bytes]:
        """Ids of each string on its own; one call for all of them."""
        if not parts:
            return []
        got = self.tokenizer.encode(parts, is_pretokenized=True, add_special_tokens=False)
        ids = np.asarray(got.ids, dtype=self.dtype).tobytes()
        part = np.asarray([-1 if w is None else w for w in got.word_ids], dtype=np.int64)
        if (part < 0).any():  # a special token's text: these ids carry no part number
            return [np.asarray(e.ids, dtype=self.dtype).tobytes()
                    for e in self.tokenizer.encode_batch_fast(parts, add_special_tokens=False)]
        ends = (np.searchsorted(part, np.arange(len(parts) + 1)) * self.dtype.itemsize).tolist()
        return [ids[a:b] for a, b in zip(ends, ends[1:])]

    def _single(self, pieces: list[str]) -> list[bytes]:
        """Ids of strings that are one piece each: the library's model alone."""
        tokenize, ids, ends = self.tokenizer.model.tokenize, [], [0]
        for piece in pieces:
            ids += [t.id for t in tokenize(charmap_decode(piece.encode(), "strict", _BYTE_LEVEL)[0])]
            ends.append(len(ids))
        packed, width = np.array(ids, dtype=self.dtype).tobytes(), self.dtype.itemsize
        return [packed[a * width:b * width] for a, b in zip(ends, ends[1:])]

    def _parts(self, texts):
        """Each text's parts between cuts, as an Arrow list array."""
        import pyarrow as pa
        import pyarrow.compute as pc

        odd = np.flatnonzero(pc.match_substring_regex(texts, f"[{_SPACES}] ").to_numpy(zero_copy_only=False))
        parts = pc.split_pattern(texts, " ")
        if not len(odd):
            return parts
        # spaces that follow white space: cut those texts one by one
        cut = pa.array([_CUT.split(t) for t in texts.take(odd).to_pylist()], parts.type)
        place = np.arange(len(texts))
        place[odd] = len(texts) + np.arange(len(odd))
        return pa.concat_arrays([parts, cut]).take(pa.array(place))

    def encode(self, texts) -> list[bytes]:
        """Packed ids of each text (``dtype``), in order; ``texts`` is a list of
        strings or an Arrow array (null: empty)."""
        import pyarrow as pa
        import pyarrow.compute as pc

        if not self.by_segment:
            texts = texts if isinstance(texts, list) else [t or "" for t in texts.to_pylist()]
            return [np.asarray(e.ids, dtype=self.dtype).tobytes()
                    for e in self.tokenizer.encode_batch(texts, add_special_tokens=False)]
        column = pa.array(texts, pa.large_string()) if isinstance(texts, list) else texts.cast(pa.large_string())
        parts = self._parts(pc.fill_null(column, ""))
        first = parts.offsets.to_numpy()
        flat = parts.flatten()
        first = first - first[0]
        coded = flat.dictionary_encode()
        number = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        heads, at = np.unique(number[first[:-1]], return_inverse=True)  # a part a text
        rest = np.ones(len(number), dtype=bool)
        rest[first[:-1]] = False
        used = np.flatnonzero(np.bincount(number[rest], minlength=len(coded.dictionary)))
        # what the batch needs: first the heads (without a space before), then the other distinct segments
        found = self._library(coded.dictionary.take(pa.array(heads)).to_pylist())
        found += self._segments(coded.dictionary.take(pa.array(used)).to_pylist())
        sizes = np.fromiter(map(len, found), np.int64, len(found)) // self.dtype.itemsize
        starts = np.cumsum(sizes) - sizes
        place = np.empty(len(coded.dictionary), dtype=np.int64)
        place[used] = len(heads) + np.arange(len(used))
        spot = place[number] if len(used) else np.zeros(len(number), dtype=np.int64)
        spot[first[:-1]] = at
        n = sizes[spot]
        ends = np.cumsum(n)
        pool = np.frombuffer(b"".join(found), dtype=self.dtype)
        ids = pool[np.repeat(starts[spot] - (ends - n), n) + np.arange(int(ends[-1]) if len(ends) else 0)].tobytes()
        cuts = (np.concatenate([[0], ends])[first] * self.dtype.itemsize).tolist()
        return [ids[a:b] for a, b in zip(cuts, cuts[1:])]

    def _segments(self, distinct: list[str]) -> list[bytes]:
        """Ids of distinct segments (given without the space before them)."""
        recent, older = self.recent, self.older
        found = list(map(recent.get, distinct))
        fresh = []
        for i, ids in enumerate(found):
            if ids is None:
                ids = found[i] = older.get(distinct[i])
                if ids is None:
                    fresh.append(i)
                else:
                    recent[distinct[i]] = ids
        for i, ids in zip(fresh, self._learn([distinct[i] for i in fresh])):
            found[i] = recent[distinct[i]] = ids
        if len(recent) > self.limit // 2:  # what has not been used for a generation makes room
            self.older, self.recent = recent, {}
        if len(self.pieces) > self.limit // 2:
            self.pieces = {}
        return found

    def _cut(self, segment: str) -> list[str]:
        """A segment with the space before it, as runs of the tokenizer's pieces:
        a line end between non-spaces and marks behind letters stand alone."""
        if any(t in segment for t in self.added):
            return [" " + segment]
        lines = segment.split("\n")
        if "" in lines or (len(lines) > 1 and _SPACE_NO_LINE.search(segment)):
            return [" " + segment]
        out = []
        for i, line in enumerate(lines):
            if i:
                out.append("\n")
            word = line.rstrip(_MARKS)
            lead = "" if i else " "
            if word != line and word.isalpha():
                out += [lead + word, line[len(word):]]
            else:
                out.append(lead + line)
        return out

    def _learn(self, fresh: list[str]) -> list[bytes]:
        """Ids of unknown segments."""
        letters = [p.isalpha() for p in fresh]
        single = [" " + p for p in compress(fresh, letters)] if self.by_piece else []
        cut = {p: self._cut(p) for p, plain in zip(fresh, letters) if not (plain and self.by_piece)}
        known, other = {}, []
        for run in set(chain.from_iterable(cut.values())).difference(single):
            word = run[1:] if run[0] == " " else run
            ids = self.pieces.get(run) if word is run else self.recent.get(word) or self.older.get(word)
            if ids is not None:
                known[run] = ids
            elif self.by_piece and (word.isalpha() or run == "\n" or not run.strip(_MARKS)):
                single.append(run)
            else:
                other.append(run)
        for runs, ids in ((single, self._single(single)), (other, self._library(other))):
            known.update(zip(runs, ids))
            self.pieces.update((run, got) for run, got in zip(runs, ids) if run[0] != " ")
        return [b"".join([known[r] for r in cut[p]]) if p in cut else known[" " + p] for p in fresh]


def worker_encoder(definition: str) -> Encoder:
    """The worker's encoder for a tokenizer definition; kept for later tasks."""
    key = hashlib.md5(definition.encode()).hexdigest()
    if key not in _WORKER:
        _WORKER.clear()
        _WORKER[key] = Encoder(definition)
    return _WORKER[key]


def ship_definition(spark: SparkSession, path: str):
    """The tokenizer file (1 to 2 MB, a vocabulary) as a broadcast variable."""
    with open(path, encoding="utf-8") as f:
        return spark.sparkContext.broadcast(f.read())


def text_batches(batch, column: str = "text", most: int = 1 << 22):
    """Slices of an Arrow batch whose texts have at most about ``most`` bytes
    together (one longer text: alone)."""
    import pyarrow.compute as pc

    sizes = pc.fill_null(pc.binary_length(batch[column]), 0).to_numpy(zero_copy_only=False)
    start, total = 0, 0
    for i, n in enumerate(sizes.tolist()):
        if i > start and total + n > most:
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += n
    if start < batch.num_rows:
        yield batch.slice(start)
