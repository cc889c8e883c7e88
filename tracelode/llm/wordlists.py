"""Words of whole texts as numbers, for the operators that compare words and not characters."""

from __future__ import annotations

import re
from itertools import chain

import numpy as np
import pyarrow as pa

#: Fixed value: a word is what stands between ASCII white space.
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def numbered(texts: list[str]) -> tuple[list[list[str]], list[np.ndarray], list[str]]:
    """The words of each text, the same as numbers (equal words have equal numbers, in all the texts), and the distinct words."""
    words = [WORD.findall(t) for t in texts]
    coded = pa.array(list(chain.from_iterable(words)), pa.large_string()).dictionary_encode()
    flat, ends = coded.indices.to_numpy(zero_copy_only=False), np.cumsum([len(w) for w in words])
    return words, np.split(flat, ends[:-1]) if len(words) else [], coded.dictionary.to_pylist()
