"""Tokens as numbers, inside tasks."""
import re
import zlib

import numpy as np

WORD = re.compile(r"\w+")
TOKEN = re.compile(r"[^\W\d_]+|\d+|[^\w\s]+|_+")


class Numbered(dict):
    """Token -> number, worked out once; forgotten when `limit` tokens are known. Only its size is bounded: a
    forgotten token gets the same number again."""

    def __init__(self, number, limit: int = 400_000):
        super().__init__()
        self.number, self.limit = number, limit

    def __missing__(self, token: str) -> int:
        out = self.number(token)
        if len(self) >= self.limit:
            self.clear()
        if len(token) <= 64:
            self[token] = out
        return out

    def all(self, tokens: list[str]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, tokens), dtype=np.int64, count=len(tokens))


def hashed(token: str, buckets: int) -> int:
    return zlib.crc32(token.encode("utf-8", "surrogatepass")) % buckets


def shape(token: str) -> int:
    """Class of a token by its look, 1 to 63; 0 is kept for a token that equals the one before."""
    if token.isdigit():
        return 1 + min(len(token), 5)
    if token.isalpha():
        if token.isupper() and len(token) > 1:
            return 7
        return 8 if token[0].isupper() else 9
    return 10 + hashed(token[:3], 54)
