"""Token counts of a byte-level BPE with a whole-token shortcut.

Offline, for every vocabulary string, the merges are run on the string alone:
those that end as one token (and are one pre-token) are proved. At run time a
pre-token that is proved counts one at once, and only the rest are merged, each
distinct one once while a worker remembers it.

Nulls and edges: a null text counts as empty, with no tokens; a special token's
string inside a text is one token, as in the library; a lone pre-token of any
length is merged by a heap, in n log n; an empty table gives an empty result;
other columns are ignored. A tokenizer file that says more than this module counts
by (`check`) is an error, not a wrong count.
"""

from __future__ import annotations

import heapq
import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

#: The published pre-token pattern of byte-level BPE, {L} and {N} standing for letters and numbers.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?[{L}]+| ?[{N}]+| ?[^{S}{L}{N}]+|[{S}]+(?![^{S}])|[{S}]+"
#: Distinct pre-tokens that a worker remembers besides the proved ones.
REMEMBERED = 400_000
NONE = 1 << 60
#: A token's id has fewer bits than this, so that a pair of ids is one number.
ID_BITS = 17


def byte_letters() -> dict[int, str]:
    """Printable Latin-1 bytes stand for themselves, the others for the letters from U+0100 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(rest)}


def char_classes() -> dict[str, str]:
    """The code points that the library's own pre-tokenizer takes for letters (L), numbers (N) and spaces (S), as
    ranges of a character class. Asking it keeps its version of Unicode; each point is seen after a, 1 and !."""
    from tokenizers.pre_tokenizers import ByteLevel

    split = ByteLevel(add_prefix_space=False).pre_tokenize_str
    ranges: dict[str, list[list[int]]] = {"L": [], "N": [], "S": []}
    for start in [*range(0, 0x40000, 4096), 0xE0000]:  # what lies beyond is unassigned or private: other
        points = [c for c in range(start, start + 4096) if not 0xD800 <= c < 0xE000]
        begins = {begin for _, (begin, _) in split("".join("a{0}1{0}!{0}x".format(chr(c)) for c in points))}
        for i, c in enumerate(points):
            kind = next((k for k, at in (("L", 1), ("N", 3), ("", 5)) if 7 * i + at not in begins), "S")
            if kind:
                if (own := ranges[kind]) and own[-1][1] == c - 1:
                    own[-1][1] = c
                else:
                    own.append([c, c])
    return {k: "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in own) for k, own in ranges.items()}


def pre_tokens(classes: dict[str, str], plane: int = 17) -> re.Pattern:
    """The pre-token pattern; for texts within the basic plane (`plane` 1) its classes are short and quick to test."""
    pattern = PATTERN
    for k, own in classes.items():
        ranges = [own[i : i + 21] for i in range(0, len(own), 21)]
        pattern = pattern.replace("{" + k + "}", "".join(r for r in ranges if plane > 1 or int(r[13:], 16) < 0x10000))
    return re.compile(pattern)


def in_basic_plane(text: str) -> bool:
    return text.isascii() or len(text.encode("utf-16-le", "surrogatepass")) == 2 * len(text)


def check(spec: dict, name: str) -> None:
    """Raises where the tokenizer file `spec` asks for more than byte-level BPE by PATTERN, with special tokens as they stand."""
    model, split = spec.get("model") or {}, spec.get("pre_tokenizer") or {}
    asked = [k for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges") if model.get(k)]
    if model.get("type", "BPE") != "BPE":
        asked.append("model")
    if spec.get("normalizer"):
        asked.append("normalizer")
    if split.get("type") != "ByteLevel" or split.get("add_prefix_space", True) or not split.get("use_regex", True):
        asked.append("pre_tokenizer")
    if any(not t.get("special") or any(t.get(k) for k in ("lstrip", "rstrip", "single_word")) for t in spec.get("added_tokens") or []):
        asked.append("added_tokens")
    if max((model.get("vocab") or {"": 0}).values()) >= 1 << ID_BITS:
        asked.append("vocab")
    if asked:
        raise ValueError(f"{name} cannot be counted by: its {', '.join(asked)} differ from byte-level BPE")


class Merges:
    """The merge table of a tokenizers .json file, by token ids."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        check(spec, path)
        vocab = spec["model"]["vocab"]
        pairs = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        # (left, right) to (rank, merged), ID_BITS apart: one whole number orders and names a merge.
        self.pair = {vocab[a] << ID_BITS | vocab[b]: rank << ID_BITS | vocab[a + b] for rank, (a, b) in enumerate(pairs)}
        letters = byte_letters()
        self.byte = [vocab[letters[b]] for b in range(256)]
        self.special = [t["content"] for t in spec.get("added_tokens", []) if t.get("special")]
        back = {c: b for b, c in letters.items()}
        self.strings = [bytes(back[c] for c in token) for token in vocab if all(c in back for c in token)]

    def count(self, data: bytes) -> int:
        """How many tokens the merges leave of `data`, one pre-token."""
        ids = [self.byte[b] for b in data]
        if len(ids) > 48:
            return self._count_long(ids)
        find = self.pair.get
        ranks = [find(a << ID_BITS | b, NONE) for a, b in zip(ids, ids[1:])]
        while ranks and (best := min(ranks)) != NONE:
            at = ranks.index(best)
            ids[at] = new = best & (1 << ID_BITS) - 1
            del ids[at + 1], ranks[at]
            if at < len(ranks):
                ranks[at] = find(new << ID_BITS | ids[at + 1], NONE)
            if at:
                ranks[at - 1] = find(ids[at - 1] << ID_BITS | new, NONE)
        return len(ids)

    def _count_long(self, ids: list[int]) -> int:
        n = left = len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        find = self.pair.get
        heap = [(r, i, ids[i], ids[i + 1]) for i in range(n - 1) if (r := find(ids[i] << ID_BITS | ids[i + 1]))]
        heapq.heapify(heap)
        while heap:
            r, i, a, b = heapq.heappop(heap)
            j = after[i]
            if ids[i] != a or j >= n or ids[j] != b:
                continue
            ids[i], ids[j] = r & (1 << ID_BITS) - 1, -1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
            left -= 1
            for x, y in ((before[i], i), (i, k)):
                if x >= 0 and y < n and (r := find(ids[x] << ID_BITS | ids[y])):
                    heapq.heappush(heap, (r, x, ids[x], ids[y]))
        return left

    def proved(self, words: re.Pattern) -> list[str]:
        """The vocabulary strings that are one pre-token and that the merges make one token."""
        out = []
        for data in self.strings:
            try:
                word = data.decode()
            except UnicodeDecodeError:
                continue
            if words.findall(word) == [word] and self.count(data) == 1:
                out.append(word)
        return out


class _Counts(dict):
    """Tokens by pre-token: the proved ones, and those merged so far."""

    def __init__(self, merges: Merges, proved: list[str]):
        super().__init__(dict.fromkeys(proved, 1))
        self.merges, self.known = merges, proved

    def __missing__(self, word: str) -> int:
        if len(self) > len(self.known) + REMEMBERED:
            self.clear()
            self.update(dict.fromkeys(self.known, 1))
        self[word] = n = self.merges.count(word.encode("utf-8", "surrogatepass"))
        return n


def count_tokens(docs: DataFrame, tokenizer: str = "byte_bpe_50k.json", limit: int = 512) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) for each row of `docs`; `tokenizer` is a file of public_tokenizers."""
    import public_tokenizers

    spark = docs.sparkSession
    merges = Merges(public_tokenizers.path(tokenizer))
    classes = char_classes()
    proved = merges.proved(pre_tokens(classes))
    merges.strings = []
    shipped = spark.sparkContext.broadcast((merges, proved, classes))  # as large as the vocabulary, whatever the input

    def count(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        merges, proved, classes = shipped.value
        counts = _Counts(merges, proved)
        every, basic = pre_tokens(classes).findall, pre_tokens(classes, 1).findall
        special = re.compile("(" + "|".join(map(re.escape, sorted(merges.special, key=len, reverse=True))) + ")") if merges.special else None

        def tokens(text: str) -> int:
            find = basic if in_basic_plane(text) else every
            if special is None or not any(s in text for s in merges.special):
                return sum(map(counts.__getitem__, find(text)))
            pieces = special.split(text)
            return len(pieces) // 2 + sum(sum(map(counts.__getitem__, find(p))) for p in pieces[::2])

        for part in parts:
            texts = [t if isinstance(t, str) else "" for t in part["text"]]
            n = [tokens(t) for t in texts]
            yield pd.DataFrame({"doc_id": part["doc_id"].astype("Int64"), "n_bytes": [len(t.encode()) for t in texts], "n_tokens": n, "over_limit": [x > limit for x in n]})

    return docs.selectExpr("cast(doc_id as bigint) doc_id", "cast(text as string) text").mapInPandas(count, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
