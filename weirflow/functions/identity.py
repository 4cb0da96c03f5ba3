"""Digests, keys and ids as Column expressions; everything stays inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Tag of our keyed digests: HMAC with SHA-256.
TAG = "hs2"
_BLOCK = 64
# Crockford's base 32 alphabet.
CROCKFORD = "0123456789ABCDEFGHJKMNPQRSTVWXYZ"


def as_bytes(x: Column) -> Column:
    return x.cast("binary")


def hex_of(x: Column) -> Column:
    """Lower-case hexadecimal digits of bytes."""
    return F.lower(F.hex(x))


def pads(key: bytes) -> tuple[bytes, bytes]:
    """The two key blocks of HMAC."""
    import hashlib

    block = (hashlib.sha256(key).digest() if len(key) > _BLOCK else key).ljust(_BLOCK, b"\0")
    return bytes(b ^ 0x36 for b in block), bytes(b ^ 0x5C for b in block)


def hmac_sha256(key: bytes, data: Column) -> Column:
    """HMAC-SHA256 of bytes, as hexadecimal digits."""
    inner, outer = pads(key)
    first = F.sha2(F.concat(F.lit(bytearray(inner)), data), 256)
    return F.sha2(F.concat(F.lit(bytearray(outer)), F.unhex(first)), 256)


def keyed_digest(key: bytes, data: Column) -> Column:
    """the identity of bytes under a tenant's key."""
    return F.concat(F.lit(f"{TAG}:"), hmac_sha256(key, data))


def u64be(n: Column) -> Column:
    """Eight bytes, most significant first."""
    return F.unhex(F.lpad(F.hex(n.cast("long")), 16, "0"))


def u32be(n: Column) -> Column:
    return F.unhex(F.lpad(F.hex(n.cast("long")), 8, "0"))


def framed(x: Column) -> Column:
    """Bytes behind their length, so that no two lists of fields read alike."""
    return F.concat(u64be(F.octet_length(x)), x)


def domain_hash(key: bytes, domain: str, *fields: Column) -> Column:
    """hash of fields under a domain; every field is framed and their number is hashed too."""
    parts = [framed(F.lit(bytearray(domain.encode()))), u64be(F.lit(len(fields))), *(framed(f) for f in fields)]
    return keyed_digest(key, F.concat(*parts))


def material_hash(key: bytes, tenant: Column, kind: Column, resource: Column, preconditions: Column, payloads: Column) -> Column:
    """hash of a request. Preconditions (array<struct<name,value>>) are sorted by name, payloads keep their order."""
    names = F.transform(F.array_sort(preconditions), lambda p: F.concat(framed(as_bytes(p["name"])), framed(as_bytes(p["value"]))))
    joined = lambda xs: F.aggregate(xs, F.lit(bytearray()), lambda a, b: F.concat(a, b))
    body = F.concat(u64be(F.size(preconditions)), joined(names), u64be(F.size(payloads)), joined(F.transform(payloads, framed)))
    return domain_hash(key, "material", as_bytes(tenant), as_bytes(kind), as_bytes(resource), body)


def stable_path(key: bytes, stable: Column) -> Column:
    """where a stable key stands in the index."""
    return domain_hash(key, "stable-path", stable)


def payload_hash(key: bytes, payload: Column) -> Column:
    return domain_hash(key, "payload", payload)


def request_hash(key: bytes, log: Column, stable: Column, payload: Column) -> Column:
    return domain_hash(key, "stable-request", as_bytes(log), stable, payload)


def document_stable_key(doc: Column, digest_hex: Column) -> Column:
    """length-framed document id and 32-byte digest."""
    return F.concat(u32be(F.octet_length(as_bytes(doc))), as_bytes(doc), u32be(F.lit(32)), F.unhex(digest_hex))


def intent_shard(identity: Column) -> Column:
    """first byte of an unkeyed hash."""
    return F.substring(F.sha2(as_bytes(identity), 256), 1, 2)


def nibble(digest_hex: Column, depth: int) -> Column:
    """The depth-th five-bit slice of a digest, most significant first; the last is padded with zeros."""
    first, bit = divmod(depth * 5, 4)
    window = F.rpad(F.substring(digest_hex, first + 1, 3), 3, "0")
    return F.shiftright(F.conv(window, 16, 10).cast("int"), 12 - 5 - bit).bitwiseAND(F.lit(31))


def crockford_encode(hex_digits: Column, bits: int) -> Column:
    """base 32, most significant first, of ``bits`` bits given as hexadecimal digits."""
    chars = -(-bits // 5)
    pad = chars * 5 - bits
    nibbles = F.transform(F.split(F.lower(hex_digits), ""), lambda c: F.lpad(F.conv(c, 16, 2), 4, "0"))
    binary = F.concat(F.lit("0" * pad), F.array_join(nibbles, ""))
    index = F.sequence(F.lit(0), F.lit(chars - 1))
    return F.array_join(F.transform(index, lambda i: F.substring(F.lit(CROCKFORD), F.conv(F.substring(binary, i * 5 + 1, F.lit(5)), 2, 10).cast("int") + 1, F.lit(1))), "")


def crockford_digits(text: Column) -> Column:
    """Folds case, I and L to 1, O to 0."""
    return F.translate(F.upper(text), "ILO", "110")


def crockford_decode(text: Column, bits: int) -> Column:
    """hexadecimal digits of base-32 text; null where a character is foreign."""
    folded = crockford_digits(text)
    fives = F.transform(F.split(folded, ""), lambda c: F.lpad(F.conv((F.instr(F.lit(CROCKFORD), c) - 1).cast("string"), 10, 2), 5, "0"))
    binary = F.substring(F.array_join(fives, ""), -bits, bits)
    index = F.sequence(F.lit(0), F.lit(bits // 4 - 1))
    decoded = F.array_join(F.transform(index, lambda i: F.lower(F.conv(F.substring(binary, i * 4 + 1, F.lit(4)), 2, 16))), "")
    return F.when(folded.rlike(f"^[{CROCKFORD}]{{{-(-bits // 5)}}}$"), decoded)


def operation_id(millis: Column, entropy_hex: Column) -> Column:
    """48 bits of time and 144 of entropy."""
    return F.concat(F.lit("op_"), crockford_encode(F.concat(F.lpad(F.hex(millis), 12, "0"), entropy_hex), 192))


def issued_at_millis(operation: Column) -> Column:
    """the time in an operation id; null if it is none."""
    return F.conv(F.substring(crockford_decode(F.regexp_extract(operation, "^[oO][pP]_(.{39})$", 1), 192), 1, 12), 16, 10).cast("long")


def stable_key_text(key: Column) -> Column:
    """the text form of a stable key."""
    return F.concat(F.lit("sk_"), hex_of(key))


def parse_stable_key(text: Column) -> Column:
    """bytes of ``sk_`` and 1 to 512 pairs of lower-case digits; null otherwise."""
    return F.when(text.rlike("^sk_(?:[0-9a-f]{2}){1,512}$"), F.unhex(F.substring(text, 4, 1024)))


def identity_kind(text: Column) -> Column:
    """F8: operation or stable; null if neither."""
    return F.when(text.startswith("op_") & issued_at_millis(text).isNotNull(), "operation").when(parse_stable_key(text).isNotNull(), "stable")


def decimal_u64(text: Column) -> Column:
    """digits without a leading zero, up to the largest unsigned 64-bit number; null otherwise."""
    n = F.when(text.rlike("^(0|[1-9][0-9]{0,19})$"), text.try_cast("decimal(20,0)"))
    return F.when(n <= F.lit("18446744073709551615").cast("decimal(20,0)"), n)


def next_seq(seq: Column) -> Column:
    """the next position; the end of the number range is an error, not a wrap."""
    return F.when(seq == (1 << 63) - 1, F.raise_error(F.lit("integrity: sequence overflow")).cast("long")).otherwise(seq + 1)


def object_key(tenant: Column, digest: Column) -> Column:
    """Digests fan out by their first two digits."""
    raw = F.substring_index(digest, ":", -1)
    return F.concat_ws("/", F.lit("objects"), tenant, F.substring(raw, 1, 2), raw)


def ref_key(tenant: Column, name: Column) -> Column:
    return F.concat_ws("/", F.lit("refs"), tenant, name)


def intent_key(tenant: Column, identity: Column) -> Column:
    return F.concat_ws("/", F.lit("ops"), tenant, intent_shard(identity), identity)


def partition_of(key: Column, n: int) -> Column:
    """The partition of a key among ``n``, by the first 32 bits of its hash."""
    return F.pmod(F.conv(F.substring(F.sha2(as_bytes(key.cast("string")), 256), 1, 8), 16, 10).cast("long"), F.lit(n)).cast("int")
