"""Content hashes, stable hashes, paths, chunks and byte ranges as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def content_hash(content: Column | str) -> Column:
    """SHA-256 of bytes or text, lower-case hex."""
    return F.sha2(col(content), 256)


def stable_hash(text: Column | str) -> Column:
    """A 64-bit hash: the first 16 bytes of SHA-256, folded as r * 31 + b with wrap-around.

    Each byte's share is b * 31 ** k, taken in halves of 32 bits: the sums of the
    halves stay far below 2 ** 63, so nothing overflows under ANSI, and only longs
    are computed with.
    """
    hexed = F.sha2(col(text), 256)
    quarters = [F.conv(F.substring(hexed, 8 * q + 1, 8), 16, 10).cast("long") for q in range(4)]
    low = high = F.lit(0).cast("long")
    for k in range(16):
        byte = F.shiftright(quarters[k // 4], 24 - 8 * (k % 4)).bitwiseAND(F.lit(255))
        share = pow(31, 15 - k, 1 << 64)
        low, high = low + byte * F.lit(share & 0xFFFFFFFF).cast("long"), high + byte * F.lit(share >> 32).cast("long")
    top = (high + F.shiftright(low, 32)).bitwiseAND(F.lit(0xFFFFFFFF))
    return F.shiftleft(top, 32).bitwiseOR(low.bitwiseAND(F.lit(0xFFFFFFFF)))


def path_of(hash_: Column | str, root: str = "blocks", suffix: str = "") -> Column:
    """root/aa/bb/hash; null for a blank hash."""
    h = col(hash_)
    made = F.concat_ws("/", F.lit(root), F.substring(h, 1, 2), F.substring(h, 3, 2), F.concat(h, F.lit(suffix)))
    return F.when(F.length(F.trim(h)) > 0, made)


def block_path(hash_: Column | str) -> Column:
    return path_of(hash_)


def manifest_path(hash_: Column | str) -> Column:
    return path_of(hash_, "manifests", ".manifest")


def backup_manifest_path(backup_id: Column | str) -> Column:
    return F.concat(F.lit("backups/"), col(backup_id), F.lit("/manifest.json"))


def shard(namespace: Column | str, n: int) -> Column:
    """shard-k of n, by the stable hash."""
    h = stable_hash(namespace)
    return F.concat(F.lit("shard-"), (F.abs(h) % n).cast("string"))


def chunks(content: Column | str, size: int) -> Column:
    """(pos, begin, end, chunk_hash) of fixed-size chunks; empty unless the content is longer than one."""
    c = col(content)
    n = F.octet_length(c)
    made = F.transform(
        F.sequence(F.lit(0), F.ceil(n / size).cast("int") - 1),
        lambda i: F.struct(
            i.alias("pos"),
            (i * size).cast("long").alias("begin"),
            F.least((i + 1) * size, n).cast("long").alias("end"),
            F.sha2(F.substring(c, i * size + 1, F.lit(size)), 256).alias("chunk_hash"),
        ),
    )
    return F.when(n > size, made).otherwise(F.slice(made, 1, 0))


def byte_range(content: Column | str, offset: Column | int, length: Column | int) -> Column:
    """Bytes from an offset, clamped to the content; a negative length reads to the end."""
    c = col(content)
    n = F.octet_length(c)
    at = F.least(F.greatest(F.lit(offset) if isinstance(offset, int) else offset, F.lit(0)), n)
    take = F.lit(length) if isinstance(length, int) else length
    take = F.when(take < 0, n - at).otherwise(F.least(take, n - at))
    return F.substring(c, at.cast("int") + 1, take.cast("int"))


def ratio(used: Column | str, total: Column | str) -> Column:
    t = col(total)
    return F.when(t == 0, F.lit(0.0)).otherwise(col(used).cast("double") / t)


def topic(trigger: Column | str) -> Column:
    return F.lower(F.concat(F.lit("object."), col(trigger)))


def transition_line(from_: Column | str, trigger: Column | str, to: Column | str) -> Column:
    """A log line; where the former state isn't known, the new one stands for it."""
    return F.format_string("[state-machine] %s --(%s)--> %s", F.coalesce(col(from_), col(to)), col(trigger), col(to))


def cursor(value: Column | str, hash_: Column | str) -> Column:
    """The token of a page that ends with this row, base64 over JSON."""
    token = F.base64(F.to_json(F.struct(col(value).alias("v"), col(hash_).alias("h")), {"ignoreNullFields": "false"}).cast("binary"))
    return F.translate(token, "\r\n", "")  # no line ends, whatever the session's setting


def cursor_hash(token: Column | str) -> Column:
    """The hash in a token; null where it can't be read."""
    return F.get_json_object(F.try_to_binary(col(token), F.lit("base64")).cast("string"), "$.h")
