"""Token ids of whole texts by a public byte-level BPE vocabulary file (bounded: one vocabulary a worker)."""

from __future__ import annotations

import json
from functools import lru_cache

import numpy as np

END_OF_DOCUMENT = 2


def _bytes_of_characters() -> dict[str, int]:
    """The printable stand-ins that byte-level vocabularies use for bytes."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


@lru_cache(maxsize=2)
def encoder(vocabulary: str, pattern: str, added_tokens: bool = False):
    """A function from text to its ids (numpy uint32). vocabulary: a tokenizers JSON file of kind byte-level BPE whose
    ids follow its merges, as is checked here; the same ids come out as from the tokenizers library with add_special_tokens=False.
    added_tokens: the file's added tokens are recognised inside texts, as the library does unless its encode_special_tokens
    is set; else they are plain text."""
    import tiktoken

    with open(vocabulary, encoding="utf-8") as f:
        spec = json.load(f)
    if spec["model"]["type"] != "BPE" or spec["pre_tokenizer"]["type"] != "ByteLevel" or spec["pre_tokenizer"].get("add_prefix_space"):
        raise ValueError(f"{vocabulary} is no byte-level BPE vocabulary without a prefix space")
    added = spec.get("added_tokens", ())
    special = {x["content"] for x in added if x.get("special")}
    to_byte = _bytes_of_characters()
    ranks = {bytes(to_byte[c] for c in token): i for token, i in spec["model"]["vocab"].items() if token not in special}
    joined = ["".join(m if isinstance(m, list) else m.split(" ")) for m in spec["model"]["merges"]]
    ids = [spec["model"]["vocab"][x] for x in joined]
    if ids != sorted(ids):
        raise ValueError(f"the ids of {vocabulary} do not follow its merges")
    known = {x["content"]: x["id"] for x in added} if added_tokens else {}
    if known:
        if any(x.get("single_word") or x.get("lstrip") or x.get("rstrip") for x in added) or spec.get("normalizer") or any(a != b and b.startswith(a) for a in known for b in known):
            raise ValueError(f"the added tokens of {vocabulary} cannot be told by their text alone")
        ranks = {token: i for token, i in ranks.items() if i not in set(known.values())}
    encoding = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens=known)
    return lambda text: np.asarray(encoding.encode_to_numpy(text or "", allowed_special="all", disallowed_special=()), np.uint32)


def document_ids(encode, text: str | None) -> np.ndarray:
    """The ids of a text and the end-of-document id, little-endian unsigned 32 bits."""
    return np.append(encode(text), END_OF_DOCUMENT).astype("<u4")
