"""Exact BPE by backtracking over Aho-Corasick matches, and decoding by an offset table.

For vocabularies whose words end in a suffix (``</w>``): lower case, white space dropped.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.llm.common import Recent, text_of, worker_object

# Unicode's white space, as the normaliser means it.
_SPACE = re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+")
_LONGEST = 48


def byte_letters() -> list[str]:
    """The letter that stands for each byte: itself if it prints, else the next from U+0100."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(0x100, 0x200))
    return [chr(b) if b in shown else chr(next(spare)) for b in range(256)]


class WordBpe:
    """A tokenizer file's BPE.

    ``encode`` follows the file's normaliser (NFC, white space to spaces, lower case) and split
    pattern, then finds each word's merges without performing them: it takes the longest token
    that matches, and goes back to a shorter one, or to the token before, wherever two
    neighbours would not have stood next to each other after the merges.
    """

    def __init__(self, path: str, limit: int = 400_000):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        vocab: dict[str, int] = spec["model"]["vocab"]
        suffix: str = spec["model"]["end_of_word_suffix"] or ""
        merges = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        # The rank of each merge by the ids it joins; the halves and the rank of each token made.
        self.rank: dict[tuple[int, int], int] = {}
        self.halves: dict[int, tuple[int, int, int]] = {}
        for rank, (a, b) in enumerate(merges):
            pair = (vocab[a], vocab[b])
            self.rank.setdefault(pair, rank)
            self.halves.setdefault(vocab[a + b], (*pair, rank))
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.special_re = re.compile("(" + "|".join(map(re.escape, self.special)) + ")")
        self.split_re = regex.compile(spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"])
        self.letters = dict(enumerate(byte_letters()))
        self.pairs: dict[tuple[int, int], bool] = {}
        # Only tokens that the merges make of their own letters can occur.
        whole = set(vocab.values()) - self.halves.keys() - set(self.special.values())
        for number, (a, b, rank) in sorted(self.halves.items(), key=lambda x: x[1][2]):
            if a in whole and b in whole and self._stand(a, b, rank):
                whole.add(number)
        # The last letter of a word and its suffix are one letter; here "\0" is the suffix.
        self.end = "\0" if suffix else ""
        self.automaton = ahocorasick.Automaton()
        for token, number in vocab.items():
            if number in whole:
                text = token[: -len(suffix)] + self.end if suffix and token.endswith(suffix) else token
                self.automaton.add_word(text, (len(text), number))
        self.automaton.make_automaton()
        self.pieces, self.words = Recent(limit), Recent(limit // 2)
        names = [b""] * (max(*vocab.values(), *self.special.values()) + 1)
        for token, number in {**vocab, **self.special}.items():
            names[number] = token.encode()
        # All tokens, a space after each, and where each begins.
        self.table = np.frombuffer(b"".join(n + b" " for n in names), dtype=np.uint8)
        self.offset = np.cumsum([0] + [len(n) + 1 for n in names])

    def _stand(self, left: int, right: int, until: int | None = None) -> bool:
        """Whether the two tokens stand side by side once all merges (before ``until``) are done.

        From the end back, the later of the two tokens' own last merges is undone; meanwhile no
        merge may have joined the letters at their border. Equal merges go from left to right.
        """
        limit = len(self.rank) + 1 if until is None else until
        while True:
            if self.rank.get((left, right), limit) < limit:
                return False
            a, b = self.halves.get(left), self.halves.get(right)
            if a is None and b is None:
                return True
            if b is None or (a is not None and a[2] > b[2]):
                # This merge lies left of the border: an equal one at the border comes later.
                left, limit = a[1], min(limit, a[2])
            else:
                # This one lies right of it: an equal one at the border comes first.
                right, limit = b[0], min(limit, b[2] + 1)

    def compatible(self, left: int, right: int) -> bool:
        found = self.pairs.get((left, right))
        if found is None:
            if len(self.pairs) > 1_000_000:
                self.pairs.clear()
            found = self.pairs[left, right] = self._stand(left, right)
        return found

    def word(self, word: str) -> list[int]:
        """The ids of one word, given in byte letters."""
        text = word + self.end
        n = len(text)
        matches: list[list[tuple[int, int]]] = [[] for _ in range(n + 1)]
        for end, match in self.automaton.iter(text):
            matches[end + 1 - match[0]].append(match)
        taken: list[tuple[int, int, int]] = []  # token, its size, which match of its place
        dead = bytearray(n + 1)  # places no token of the result begins at
        at, choice = 0, len(matches[0]) - 1
        while at < n:
            while choice >= 0:
                size, token = matches[at][choice]
                if not dead[at + size] and (not taken or self.compatible(taken[-1][0], token)):
                    break
                choice -= 1
            if choice >= 0:
                taken.append((token, size, choice))
                at += size
                choice = len(matches[at]) - 1
            elif taken:
                dead[at] = 1
                _, size, choice = taken.pop()
                at, choice = at - size, choice - 1
            else:
                raise ValueError(f"no tokens for {word!r}")
        return [token for token, _, _ in taken]

    def split(self, text: str) -> list[str]:
        """The words of a text without special tokens, normalised."""
        text = _SPACE.sub(" ", unicodedata.normalize("NFC", text))
        # Letter by letter: a sigma's lower case must not depend on its place.
        text = "".join(c.lower() for c in text) if "Σ" in text else text.lower()
        return self.split_re.findall(text)

    def _piece(self, piece: str) -> bytes:
        ids: list[int] = []
        for part in self.special_re.split(piece):
            if part in self.special:
                ids.append(self.special[part])
                continue
            for word in self.split(part):
                found = self.words.get(word)
                if found is None:
                    found = self.word(word.encode().decode("latin-1").translate(self.letters))
                    if len(word) <= _LONGEST:
                        self.words.put(word, found)
                ids += found
        return np.array(ids, dtype="<u4").tobytes()

    def encode(self, text: str) -> np.ndarray:
        """The ids of a whole text, little-endian uint32. White space parts it exactly."""
        out = []
        for piece in text.replace("\n", " ").split(" "):
            found = self.pieces.young.get(piece)
            if found is None:
                found = self.pieces.get(piece)
            if found is None:
                found = self._piece(piece)
                if len(piece) <= _LONGEST:
                    self.pieces.put(piece, found)
            out.append(found)
        return np.frombuffer(b"".join(out), dtype="<u4")

    def decode(self, ids: np.ndarray) -> bytes:
        """The tokens' strings with spaces between, as UTF-8, gathered through the offset table."""
        if not len(ids):
            return b""
        start, end = self.offset[ids], self.offset[ids.astype(np.int64) + 1]
        sizes = end - start
        places = np.repeat(start - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())
        return self.table[places[:-1]].tobytes()


def word_bpe(path: str) -> WordBpe:
    """This worker's encoder for a tokenizer file."""
    return worker_object(f"word_bpe:{path}", lambda: WordBpe(path))


def encode_decode(docs: DataFrame, tokenizer: str, keep: bool = False) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256[, ids, decoded]) per row.

    A null text is empty; an empty one has no ids and decodes to an empty text. Null and
    repeated doc_ids are kept as they are.
    """

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bpe = word_bpe(tokenizer)
        for batch in batches:
            out = []
            for text in batch["text"]:
                ids = bpe.encode(text)
                decoded = bpe.decode(ids)
                row = (len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256(decoded).hexdigest())
                out.append(row + ((ids.astype(np.int32), decoded.decode()) if keep else ()))
            names = ["n_tokens", "ids_sha256", "decoded_sha256"] + ["ids", "decoded"] * keep
            made = pd.DataFrame(out, columns=names)
            made.insert(0, "doc_id", batch["doc_id"].astype("Int64").to_numpy())
            yield made.astype({"doc_id": "Int64"})

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + (", ids array<int>, decoded string" if keep else "")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text")).mapInPandas(work, schema)
