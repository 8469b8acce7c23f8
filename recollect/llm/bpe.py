"""Encoding of a corpus with a public byte-level BPE vocabulary.

Method: a pair occurrence index.  The distinct words of an Arrow batch are laid out in
one array of symbols; every adjacent pair is indexed with all its positions; the ranks
that occur are applied in ascending order, each at all its positions at once, and only
the lists of the pairs that touch a merged position are updated.  A merge can only
create pairs of a higher rank (they hold the new symbol), so one ascending sweep over
the whole batch gives each word the same ids as encoding it alone.

Null and empty texts get an empty list.  Text that looks like a special token is
ordinary text.  Blank, very long and repeated texts need no special case: a word of
n bytes costs O(n log n).
"""

from __future__ import annotations

import heapq
import json
from itertools import chain

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recollect.functions.arrow import task_mapper

#: Folder of the public vocabularies; a parameter of every function that needs one.
TOKENIZERS = "/opt/tokenizers"
VOCABULARY = "byte_bpe_50k.json"

#: Fixed value: how the vocabulary's text is split into words before the merges.
WORDS = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

#: Words whose ids a worker keeps; beyond it the oldest half is forgotten (speed only).
KEPT_WORDS = 200_000


def _letters_of_bytes() -> list[str]:
    """The printable letter that stands for each byte in vocabulary files."""
    plain = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    spare = iter(range(256, 512))
    kept = set(plain)
    return [chr(b) if b in kept else chr(next(spare)) for b in range(256)]


class Vocabulary:
    """Ids of single bytes, and for each mergeable pair of ids its rank and result."""

    def __init__(self, file: str):
        model = json.load(open(file, encoding="utf-8"))["model"]
        ids = model["vocab"]
        self.of_byte = [ids[letter] for letter in _letters_of_bytes()]
        self.merges: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, merge in enumerate(model["merges"]):
            left, right = merge.split(" ") if isinstance(merge, str) else merge
            self.merges[ids[left], ids[right]] = rank, ids[left + right]


def encode_words(words: list[bytes], vocabulary: Vocabulary) -> list[list[int]]:
    """Ids of every word, by one ascending sweep over an index of pair occurrences."""
    merges, of_byte = vocabulary.merges, vocabulary.of_byte
    end = -1  # stands between words, so that no pair spans two of them
    symbols: list[int] = [end]
    starts = []
    for word in words:
        starts.append(len(symbols))
        symbols += [of_byte[b] for b in word]
        symbols.append(end)
    following = list(range(1, len(symbols) + 1))
    before = list(range(-1, len(symbols) - 1))
    positions: dict[tuple[int, int], list[int]] = {}
    for at, pair in enumerate(zip(symbols, symbols[1:])):
        if pair in merges:
            positions.setdefault(pair, []).append(at)
    active = [(merges[pair][0], pair) for pair in positions]
    heapq.heapify(active)
    gone = -2
    while active:
        _, pair = heapq.heappop(active)
        left, right = pair
        merged = merges[pair][1]
        for at in sorted(positions.pop(pair)):
            after = following[at]
            if symbols[at] != left or symbols[after] != right:
                continue  # an overlapping occurrence took one of the two
            symbols[at] = merged
            symbols[after] = gone
            then = following[after]
            following[at] = then
            before[then] = at
            for place, new in ((before[at], (symbols[before[at]], merged)), (at, (merged, symbols[then]))):
                if new in merges:
                    if new in positions:
                        positions[new].append(place)
                    else:
                        positions[new] = [place]
                        heapq.heappush(active, (merges[new][0], new))
    out = []
    for start in starts:
        ids, at = [], start
        while symbols[at] != end:
            ids.append(symbols[at])
            at = following[at]
        out.append(ids)
    return out


class Encoder:
    """Encodes lists of texts; keeps the ids of words it has met."""

    def __init__(self, folder: str = TOKENIZERS, name: str = VOCABULARY):
        import regex

        self.vocabulary = Vocabulary(f"{folder}/{name}")
        self.split = regex.compile(WORDS).findall
        self.known: dict[str, list[int]] = {}

    def __call__(self, texts: list[str | None]) -> list[list[int]]:
        known = self.known
        if len(known) > KEPT_WORDS:
            for word in list(known)[: KEPT_WORDS // 2]:
                del known[word]
        split = [self.split(text) if text else [] for text in texts]
        fresh = list({word for words in split for word in words if word not in known})
        if fresh:
            known.update(zip(fresh, encode_words([word.encode() for word in fresh], self.vocabulary)))
        return [list(chain.from_iterable(map(known.__getitem__, words))) for words in split]


def encode_corpus(df: DataFrame, key: str = "doc_id", text: str = "text", folder: str = TOKENIZERS, name: str = VOCABULARY) -> DataFrame:
    """(key, ids): each text's token ids without special tokens.

    One narrow pass, no shuffle; columns other than ``key`` and ``text`` are never read.
    Null and empty texts give an empty list; a null key stays null; repeated rows stay
    repeated; an empty table gives an empty one.
    """

    def make():
        encoder = Encoder(folder, name)
        return lambda keys, texts: (keys, encoder(texts))

    kind = df.schema[key].dataType.simpleString()
    return task_mapper(df, [F.col(f"`{key}`"), F.col(f"`{text}`")], f"`{key}` {kind}, ids array<int>", make)


def count_tokens(df: DataFrame, keys: list[str], text: str = "text", folder: str = TOKENIZERS, name: str = VOCABULARY) -> DataFrame:
    """(keys..., n_tokens): sizes of the texts in tokens; null and empty texts have 0."""

    def make():
        encoder = Encoder(folder, name)
        return lambda *lists: (*lists[:-1], [len(ids) for ids in encoder(lists[-1])])

    schema = "".join(f"`{k}` {df.schema[k].dataType.simpleString()}, " for k in keys) + "n_tokens bigint"
    return task_mapper(df, [*(F.col(f"`{k}`") for k in keys), F.col(f"`{text}`")], schema, make)
