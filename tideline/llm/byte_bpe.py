"""Byte-level BPE ids from the tokenizers library, with a cache of space-separated pieces."""

from __future__ import annotations

import os
import re
import string
import struct
from collections.abc import Iterator

import numpy as np

from tideline.llm.common import worker_object

# The pre-tokenizer never joins what lies on both sides of a space that is followed by one of
# these characters, and gives that space to the right side. So a text may be cut there.
_INK = "!-~¡-ɏ"
_NOT_ALL_CUT = re.compile(f" (?![{_INK}])")
_CUT = re.compile(f" (?=[{_INK}])")
# Letters for the pre-tokenizer, as A-Z and a-z are.
_LATIN = "À-ÖØ-öø-ɏ"


class CachedEncoder:
    """Ids of whole texts, equal to the library's own, from its ids of each different piece.

    About ``limit`` pieces used last are kept, and as many of before. Pieces longer than
    ``longest`` characters (texts without spaces) are not kept.
    """

    def __init__(self, path: str, limit: int = 350_000, longest: int = 48):
        # A task has one core; the library's own threads would only wait for each other.
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.model = self.tokenizer.model
        self.limit, self.longest = limit, longest
        self.cache: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.plain = self._plain_pieces()

    def _plain_pieces(self) -> re.Pattern | None:
        """Pieces whose parting into runs is known: letters, digits, marks, single line ends within.

        Apostrophes are left out, for the pre-tokenizer's contractions, and the marks of added
        tokens. None, if the tokenizer is not the plain byte-level one, or an added token has no mark.
        """
        from tokenizers.pre_tokenizers import ByteLevel

        before, added = self.tokenizer.pre_tokenizer, self.tokenizer.get_added_tokens_decoder().values()
        marks = set(string.punctuation).difference("'")
        if not isinstance(before, ByteLevel) or before.add_prefix_space or not before.use_regex or self.tokenizer.normalizer is not None:
            return None
        if any(marks.isdisjoint(token.content) for token in added):
            return None
        spell = ByteLevel(add_prefix_space=False, use_regex=False).pre_tokenize_str
        self.space, self.spelling = spell(" ")[0][0], {c: spell(chr(c))[0][0] for c in [10, *range(0xC0, 0x250)]}
        marks = re.escape("".join(sorted(marks.difference(*(token.content for token in added)))))
        self.runs = re.compile(f"[A-Za-z{_LATIN}]+|[0-9]+|[{marks}]+|\n").findall
        ink = f"[A-Za-z{_LATIN}0-9{marks}]+"
        return re.compile(f"{ink}(?:\n{ink})*")

    def _encode(self, texts: list[str]) -> list[bytes]:
        found = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(x.ids, dtype="<u4").tobytes() for x in found]

    def _run(self, run: str, space: str = "") -> bytes:
        """Ids by the library's model of a run that the pre-tokenizer keeps to itself."""
        ids = [t.id for t in self.model.tokenize(space + (run if run.isascii() and run != "\n" else run.translate(self.spelling)))]
        return struct.pack(f"<{len(ids)}I", *ids)

    def _images(self, pieces: list[str]) -> list[bytes]:
        """The ids of each different piece with a space before it.

        Plain pieces that are not in the cache go to the library's model run by run, without its
        costlier pre-tokenizer; all others go through the whole tokenizer.
        """
        if len(self.cache) > self.limit:
            self.old, self.cache = self.cache, {}
        cache, old, longest = self.cache, self.old, self.longest
        images = list(map(cache.get, pieces))
        rest, inner = [], {}
        for i in [i for i, image in enumerate(images) if image is None]:
            piece = pieces[i]
            found = old.get(piece)
            if found is None:
                if piece.isascii() and piece.isalpha() and self.plain is not None:
                    found = self._run(piece, self.space)
                elif self.plain is not None and self.plain.fullmatch(piece):
                    first, *others = self.runs(piece)
                    found = cache.get(first) or old.get(first) or self._run(first, self.space)
                    if len(first) <= longest:
                        cache[first] = found
                    for run in others:
                        if run not in inner:
                            inner[run] = self._run(run)
                    found += b"".join([inner[run] for run in others])
                else:
                    rest.append(i)
                    continue
            images[i] = found
            if len(piece) <= longest:
                cache[piece] = found
        for i, found in zip(rest, self._encode([" " + pieces[i] for i in rest])):
            images[i] = found
            if len(pieces[i]) <= longest:
                cache[pieces[i]] = found
        return images

    def encode(self, texts: list[str], together: int = 1 << 21) -> Iterator[np.ndarray]:
        """The ids of each text as little-endian uint32, some ``together`` characters at a time."""
        block, size = [], 0
        for text in texts:
            block.append(text)
            size += len(text)
            if size >= together:
                yield from self._block(block)
                block, size = [], 0
        if block:
            yield from self._block(block)

    def _block(self, texts: list[str]) -> Iterator[np.ndarray]:
        """Ids of some texts: Arrow cuts them and numbers the pieces, so that Python meets each
        different piece once; the ids of all places are then gathered from those of the pieces."""
        import pyarrow as pa
        import pyarrow.compute as pc

        odd = np.array([_NOT_ALL_CUT.search(t) is not None for t in texts])
        cut = pc.split_pattern(pa.array([t for t, o in zip(texts, odd) if not o], pa.large_string()), " ")
        cut = pa.concat_arrays([cut, pa.array([_CUT.split(t) for t, o in zip(texts, odd) if o], cut.type)])
        row = np.argsort(np.argsort(odd, kind="stable"))
        heads, ends = cut.offsets.to_numpy()[:-1], cut.offsets.to_numpy()[1:]
        words = cut.flatten()
        numbered = words.dictionary_encode()
        piece = numbered.indices.to_numpy()
        inner = np.ones(len(piece), dtype=bool)
        inner[heads] = False
        used = np.zeros(len(numbered.dictionary), dtype=bool)
        used[piece[inner]] = True
        pieces = numbered.dictionary.filter(pa.array(used)).to_numpy(zero_copy_only=False).tolist()
        # What a text begins with has no space before it.
        piece = (np.cumsum(used) - 1)[piece]
        piece[heads] = len(pieces) + np.arange(len(texts))

        images = self._images(pieces) + self._encode(words.take(pa.array(heads)).to_pylist())
        ids, sizes = np.frombuffer(b"".join(images), dtype="<u4"), np.fromiter(map(len, images), np.int64, len(images)) // 4
        starts, sizes = (np.cumsum(sizes) - sizes)[piece], sizes[piece]
        upto = np.cumsum(sizes)
        at = np.repeat(starts - (upto - sizes), sizes)
        at += np.arange(upto[-1])
        found = np.split(ids[at], upto[ends[:-1] - 1])
        yield from (found[r] for r in row)


def encoder(path: str, limit: int = 350_000) -> CachedEncoder:
    """This worker's encoder for a tokenizer file."""
    return worker_object(f"byte_bpe:{path}:{limit}", lambda: CachedEncoder(path, limit))
