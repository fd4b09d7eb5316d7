"""Encrypted log lines: AES-256-GCM envelopes with native functions, keys derived by scrypt on the driver."""

from __future__ import annotations

import base64
import hashlib
import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Text authenticated with every envelope; logs sealed by another program need that program's.
AAD = "tidemark/enc/v1"


def key_record(salt: bytes, n: int = 16384, r: int = 8, p: int = 1) -> str:
    return json.dumps({"__kdf__": "scrypt", "salt": base64.b64encode(salt).decode(), "n": n, "r": r, "p": p})


def read_key_record(line: str) -> dict | None:
    """Parameters of a key record, None if the line is none; refuses other functions and unreasonable costs."""
    try:
        x = json.loads(line)
    except ValueError:
        return None
    if not isinstance(x, dict) or x.get("__kdf__") != "scrypt":
        return None
    if not all(isinstance(x.get(k), int) and 0 < x[k] <= 1 << 20 for k in ("n", "r", "p")) or not isinstance(x.get("salt"), str):
        raise ValueError("key record with bad parameters")
    return {"salt": base64.b64decode(x["salt"]), "n": x["n"], "r": x["r"], "p": x["p"]}


def derive_key(passphrase: str, salt: bytes, n: int = 16384, r: int = 8, p: int = 1) -> bytes:
    return hashlib.scrypt(passphrase.encode(), salt=salt, n=n, r=r, p=p, maxmem=256 << 20, dklen=32)


def encode_line(line: Column, key: bytes, iv: Column | None = None, aad: str = AAD) -> Column:
    """Envelope of a line. The IV is random for each line unless given (12 bytes); never reuse one with a key."""
    iv = F.substring(F.unhex(F.replace(F.uuid(), F.lit("-"), F.lit(""))), 1, 12) if iv is None else iv
    sealed = F.aes_encrypt(line, F.lit(bytearray(key)), F.lit("GCM"), F.lit("DEFAULT"), iv, F.lit(aad))
    envelope = F.to_json(F.struct(F.lit(1).alias("__enc__"), F.base64(F.substring(sealed, 1, 12)).alias("iv"), F.base64(sealed.substr(F.lit(13), F.length(sealed))).alias("ct")))
    return F.when(line.isNotNull(), envelope)


def decode_line(line: Column, key: bytes, aad: str = AAD) -> Column:
    """The line in an envelope, null where it does not authenticate; lines that are no envelope pass as they are."""
    x = F.from_json(line, "__enc__ int, iv string, ct string")
    sealed = F.concat(F.unbase64(x["iv"]), F.unbase64(x["ct"]))
    plain = F.try_aes_decrypt(sealed, F.lit(bytearray(key)), F.lit("GCM"), F.lit("DEFAULT"), F.lit(aad)).cast("string")
    return F.when(x["__enc__"].isNull(), line).otherwise(plain)


def encode_log(lines: DataFrame, key: bytes) -> DataFrame:
    """seq, value with every line sealed, order kept."""
    return lines.select("seq", encode_line(F.col("value"), key).alias("value"))


def change_key(lines: DataFrame, old: bytes | None, new: bytes | None) -> DataFrame:
    """Lines under another key: plain to sealed, sealed to plain, or from key to key; order and history are kept.

    A line that the old key does not open fails the job, so no log is replaced by lines that are lost.
    """
    plain = decode_line(F.col("value"), old) if old else F.col("value")
    unopened = F.raise_error(F.concat(F.lit("the key does not open line "), F.col("seq").cast("string"))).cast("string")
    opened = lines.select("seq", F.when(plain.isNull() & F.col("value").isNotNull(), unopened).otherwise(plain).alias("value"))
    return encode_log(opened, new) if new else opened
