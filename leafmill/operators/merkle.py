"""Merkle commitments over ordered documents.

A leaf is ``sha256(00 | digest)``, an inner node ``sha256(01 | left | right)``; the
last node of an odd level is its own partner; no documents give ``sha256('')``.
"""

from __future__ import annotations

import base64
import hashlib
import json
import os
import zipfile

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.files import replace

#: Leaves of an aligned block that one group folds, as a power of two.
FOLD = 10


def _sha(c) -> Column:
    return F.unhex(F.sha2(c, 256))


def doc_hash(data) -> Column:
    return F.sha2(data, 256)


def leaf_hash(digest) -> Column:
    """Of a digest in hexadecimal."""
    return _sha(F.concat(F.unhex(F.lit("00")), F.unhex(digest)))


def node_hash(left, right) -> Column:
    return _sha(F.concat(F.unhex(F.lit("01")), left, right))


def _fold(level: DataFrame, bits: int) -> DataFrame:
    """``bits`` levels at once: an aligned block of nodes becomes one, within one group and in the JVM."""
    block = F.transform(F.sort_array(F.collect_list(F.struct("pos", "h"))), lambda x: x["h"])
    up = level.groupBy(F.shiftright("pos", bits).alias("pos")).agg(block.alias("hs"))
    for _ in range(bits):
        size = F.size("hs")
        pairs = F.transform(
            F.sequence(F.lit(0), F.shiftright(size - 1, 1)),
            lambda i: node_hash(F.element_at("hs", (2 * i + 1).cast("int")), F.element_at("hs", F.least(2 * i + 2, F.size("hs")).cast("int"))),
        )
        # a lone block goes up as far as the tree does, see merkle_root
        up = up.withColumn("hs", pairs)
    return up.select("pos", F.element_at("hs", 1).alias("h"))


def merkle_levels(leaves: DataFrame):
    """From ``pos, h``: yields the number of nodes and the DataFrame of each level, up to the root."""
    n = leaves.count()
    level = leaves.select(F.col("pos").cast("long").alias("pos"), "h")
    yield n, level
    while n > 1:
        bits = 0
        while bits < FOLD and (n - 1) >> bits:
            bits += 1
        level, n = _fold(level, bits), ((n - 1) >> bits) + 1
        yield n, level


def merkle_root(docs: DataFrame, digest: str = "doc_sha256", order: str = "pos") -> DataFrame:
    """One row ``doc_count, merkle_root_hex``; ``order`` must count 0, 1, 2, ..."""
    spark = docs.sparkSession
    leaves = docs.select(F.col(order).cast("long").alias("pos"), leaf_hash(F.col(digest)).alias("h"))
    count = None
    for n, level in merkle_levels(leaves):
        count = n if count is None else count
    if not count:
        return spark.range(1).select(F.lit(0).cast("long").alias("doc_count"), F.lit(hashlib.sha256(b"").hexdigest()).alias("merkle_root_hex"))
    return level.select(F.lit(count).cast("long").alias("doc_count"), F.lower(F.hex("h")).alias("merkle_root_hex"))


def verify_root(commitment: DataFrame, docs: DataFrame, digest: str = "doc_sha256", order: str = "pos") -> DataFrame:
    """``match, derived, expected`` of a commitment and the documents that came."""
    derived = merkle_root(docs, digest, order).select(F.col("merkle_root_hex").alias("derived"))
    expected = commitment.select(F.col("merkle_root_hex").alias("expected"))
    return derived.crossJoin(F.broadcast(expected)).select((F.col("derived") == F.col("expected")).alias("match"), "derived", "expected")


SIGNED = tuple("corpus doc_count merkle_root_hex ts public_key".split())
_PLAIN = json.JSONEncoder(separators=(",", ":"), sort_keys=True)
_HELP = b"Derive the Merkle root of the documents and compare it with merkle_root_hex; check the signature over the canonical JSON."
_PARTS = {"said": "commitment.json", "proof": "commitment.json.ots", "stream": "stream.bin", "help": "VERIFY.txt"}


def canonical_json(commitment: dict) -> bytes:
    """What is signed: the signed fields, keys in order, no blanks."""
    return _PLAIN.encode({k: commitment[k] for k in SIGNED if k in commitment}).encode()


def write_bundle(path: str, commitment: dict, stream: bytes | None = None, proof: bytes | None = None) -> None:
    parts = {"said": json.dumps(commitment, indent=1).encode(), "proof": proof, "stream": stream, "help": _HELP}
    with zipfile.ZipFile(path, mode="w", compression=zipfile.ZIP_DEFLATED) as z:
        for part, data in parts.items():
            if data is not None:
                z.writestr(_PARTS[part], data)


def save_receipt(receipt: dict, path: str) -> tuple[str, str | None]:
    """Writes a receipt as JSON and its time proof, where it holds one in base 64, beside it; the two paths."""
    replace(path, json.dumps(receipt, indent=1, sort_keys=True).encode())
    proof = receipt.get("ots_receipt_b64")
    if not proof:
        return path, None
    beside = os.path.splitext(path)[0] + ".ots"
    replace(beside, base64.b64decode(proof))
    return path, beside


def verify_bundle(path: str) -> dict:
    """State of the signature and of the time proof: VALID, INVALID or SKIPPED where the library or part isn't there."""
    with zipfile.ZipFile(path) as z:
        there = {part: z.read(name) for part, name in _PARTS.items() if name in z.namelist()}
    commitment, proof = json.loads(there["said"]), there.get("proof")
    try:
        from nacl.exceptions import BadSignatureError
        from nacl.signing import VerifyKey
    except ImportError:
        signature = "SKIPPED"
    else:
        try:
            VerifyKey(bytes.fromhex(commitment["public_key"])).verify(canonical_json(commitment), bytes.fromhex(commitment["signature"]))
            signature = "VALID"
        except (KeyError, ValueError, BadSignatureError):
            signature = "INVALID"
    digest = None if proof is None else hashlib.sha256(canonical_json(commitment)).digest() in proof
    passed = signature == "VALID" and digest is not False
    return {"signature": signature, "digest_match": digest, "commitment": commitment, "verdict": "PASS" if passed else "SKIPPED" if signature == "SKIPPED" and digest is not False else "FAIL"}
