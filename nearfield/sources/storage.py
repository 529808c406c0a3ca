"""Where files go: URI templates, codecs and encryption as Spark options."""

from __future__ import annotations

import gzip
import hashlib
import threading

from pyspark.sql import Column
from pyspark.sql import functions as F

SCHEMES = ("file", "mem", "hdfs", "s3a", "gs", "abfss", "viewfs")


class Resolver:
    """Keys to folders: named URIs, ``{ns}`` stands for the key. Keys without
    one go to ``default``, which has to be a folder that all machines share."""

    def __init__(self, uris: dict[str, str] | None = None, default: str | None = None):
        self.uris, self.default, self.known = uris or {}, default, {}

    def path(self, key: str) -> str:
        if key not in self.known:
            uri = self.uris.get(key, self.default)
            if uri is None:
                raise KeyError(f"no folder is named for {key!r}")
            uri = uri.replace("{ns}", key)
            scheme = uri.split(":", 1)[0] if "://" in uri else "file"
            if scheme not in SCHEMES:
                raise ValueError(f"unknown scheme {scheme!r}")
            self.known[key] = uri
        return self.known[key]


def compressed(codec: str = "zstd") -> dict[str, str]:
    """Options for ``df.write.options``."""
    if codec not in ("none", "gzip", "zstd", "snappy", "lz4"):
        raise ValueError(f"unknown codec {codec!r}")
    return {"compression": codec}


def encrypted(col: Column, key: Column) -> Column:
    """AES-GCM with a fresh nonce for each value; the nonce comes first."""
    return F.aes_encrypt(col, key, F.lit("GCM"), F.lit("DEFAULT"))


def decrypted(col: Column, key: Column) -> Column:
    return F.aes_decrypt(col, key, F.lit("GCM"), F.lit("DEFAULT"))


def derived_key(password: str, salt: bytes, rounds: int = 100_000) -> bytes:
    """256 bits by PBKDF2 with SHA-256, for ``encrypted``."""
    if len(salt) < 16:
        raise ValueError("the salt has to have 16 bytes or more")
    return hashlib.pbkdf2_hmac("sha256", password.encode(), salt, rounds, 32)


class MemoryFiles:
    """What ``Files`` offers, in the driver's memory: for tests and scratch."""

    def __init__(self):
        self.data: dict[str, bytes] = {}
        self.lock = threading.Lock()

    def read(self, path: str) -> str | None:
        return self.data[path].decode() if path in self.data else None

    def read_bytes(self, path: str) -> bytes:
        return self.data[path]

    def write(self, path: str, data: str | bytes) -> None:
        self.data[path] = data.encode() if isinstance(data, str) else bytes(data)

    def make_new(self, path: str, text: str) -> bool:
        with self.lock:
            if path in self.data:
                return False
            self.data[path] = text.encode()
            return True

    def copy(self, source: str, target: str) -> None:
        self.data[target] = self.data[source]

    def names(self, path: str) -> list[str]:
        start = path.rstrip("/") + "/"
        return sorted({p[len(start) :].split("/")[0] for p in self.data if p.startswith(start)})

    def delete(self, path: str) -> None:
        for p in [p for p in self.data if p == path or p.startswith(path.rstrip("/") + "/")]:
            del self.data[p]

    def age(self, path: str) -> float | None:
        return 0.0 if path in self.data else None


class CodedFiles:
    """Files that are compressed, encrypted or both on their way into another
    store (``encode`` and ``decode`` are inverse)."""

    def __init__(self, files, encode, decode):
        self.files, self.encode, self.decode = files, encode, decode

    def write(self, path: str, data: str | bytes) -> None:
        self.files.write(path, self.encode(data.encode() if isinstance(data, str) else data))

    def read_bytes(self, path: str) -> bytes:
        return self.decode(self.files.read_bytes(path))

    def names(self, path: str) -> list[str]:
        return self.files.names(path)

    def delete(self, path: str) -> None:
        self.files.delete(path)


def zipped(files) -> CodedFiles:
    return CodedFiles(files, gzip.compress, gzip.decompress)
