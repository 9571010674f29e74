"""Whether decoded bytes are a key, a key store or a signed token, by their own structure.

Nothing here searches text; ``secret_scan`` brings candidates. A form counts only if its nested lengths fit each other to the byte, so random
bytes of the right alphabet don't. Every reader returns None for what it doesn't know, and how many bytes the form takes for what it does.
"""

from __future__ import annotations

import base64
import binascii
import json

# Fixed values of the public key formats: object identifiers in dotted form, and the file mark of an OpenSSH key.
RSA = "1.2.840.113549.1.1.1"
EC = "1.2.840.10045.2.1"
CURVES = {"1.3.101.110": ("x25519", 32), "1.3.101.111": ("x448", 56), "1.3.101.112": ("ed25519", 32), "1.3.101.113": ("ed448", 57)}
ENCRYPTED = ("1.2.840.113549.1.5.", "1.2.840.113549.1.12.1.")
STORES = ("1.2.840.113549.1.7.1", "1.2.840.113549.1.7.2")
SSH_MARK = b"openssh-key-v1\0"

INTEGER, BITS, OCTETS, OID, SEQUENCE = 2, 3, 4, 6, 48


def der_at(data: bytes, pos: int, end: int) -> tuple[int, int, int] | None:
    """Tag, first byte and end of the value at ``pos``; lengths are definite and as short as they can be."""
    if pos + 2 > end:
        return None
    tag, size, pos = data[pos], data[pos + 1], pos + 2
    if size >= 128:
        n = size - 128
        if not 1 <= n <= 8 or pos + n > end or data[pos] == 0:
            return None
        size, pos = int.from_bytes(data[pos : pos + n], "big"), pos + n
        if size < 128:
            return None
    return (tag, pos, pos + size)


def children(data: bytes, pos: int, end: int) -> list[tuple[int, int, int]] | None:
    """The values inside a value, if they fill it exactly."""
    out = []
    while pos < end:
        found = der_at(data, pos, end)
        if found is None or found[2] > end:
            return None
        out.append(found)
        pos = found[2]
    return out


def dotted(body: bytes) -> str | None:
    if not body or body[-1] & 128:
        return None
    out, value = [], 0
    for byte in body:
        value = value << 7 | byte & 127
        if not byte & 128:
            if not out:
                first = min(value // 40, 2)
                out += [first, value - 40 * first]
            else:
                out.append(value)
            value = 0
    return ".".join(map(str, out))


def _numbers(data: bytes, parts) -> list[int] | None:
    if any(tag != INTEGER or a == b for tag, a, b in parts):
        return None
    return [int.from_bytes(data[a:b], "big", signed=True) for _, a, b in parts]


def _algorithm(data: bytes, part) -> str | None:
    if part[0] != SEQUENCE:
        return None
    inside = children(data, *part[1:])
    return dotted(data[inside[0][1] : inside[0][2]]) if inside and inside[0][0] == OID else None


def _plain_key(data: bytes, parts) -> str | None:
    """RSA, DSA and elliptic-curve keys as their own standards write them."""
    if len(parts) in (6, 9, 10):
        n = _numbers(data, parts[:9])
        if n and len(parts) >= 9 and n[0] == len(parts) - 9 and min(n[1:]) > 0 and min(n[4:6]) > 1:
            # With two primes, they must give the modulus and the private exponent its two remainders.
            if n[0] == 1 or (n[4] * n[5] == n[1] and n[3] % (n[4] - 1) == n[6] and n[3] % (n[5] - 1) == n[7]):
                return f"rsa {n[1].bit_length()}"
        if n and len(parts) == 6 and n[0] == 0 and 1 < n[5] < n[2] < n[1] and 1 < n[4] < n[1]:
            return f"dsa {n[1].bit_length()}"
    if 2 <= len(parts) <= 4 and parts[1][0] == OCTETS and parts[1][2] - parts[1][1] >= 16 and _numbers(data, parts[:1]) == [1]:
        if all(tag in (0xA0, 0xA1) and children(data, a, b) for tag, a, b in parts[2:]):
            return f"ec {8 * (parts[1][2] - parts[1][1])}"
    return None


def _wrapped_key(data: bytes, parts) -> str | None:
    """A key inside the envelope that names its algorithm."""
    if not 3 <= len(parts) <= 5 or parts[2][0] != OCTETS or _numbers(data, parts[:1]) not in ([0], [1]):
        return None
    name, (_, a, b) = _algorithm(data, parts[1]), parts[2]
    inner = der_at(data, a, b)
    if name is None or inner is None or inner[2] != b:
        return None
    if name in CURVES:
        kind, size = CURVES[name]
        return kind if inner[0] == OCTETS and inner[2] - inner[1] == size else None
    if name in (RSA, EC):
        inside = children(data, *inner[1:]) if inner[0] == SEQUENCE else None
        found = _plain_key(data, inside) if inside else None
        return found if found and found.startswith("rsa" if name == RSA else "ec") else None
    return f"algorithm {name}" if inner[0] in (INTEGER, OCTETS, SEQUENCE) else None


def _der_key(data: bytes) -> tuple[str, str, int] | None:
    outer = der_at(data, 0, len(data))
    if outer is None or outer[0] != SEQUENCE or outer[2] > len(data):
        return None
    parts = children(data, *outer[1:])
    if not parts:
        return None
    found = _plain_key(data, parts) or _wrapped_key(data, parts)
    if found:
        return ("private_key", found, outer[2])
    if len(parts) == 2 and parts[1][0] == OCTETS and parts[1][2] > parts[1][1]:
        name = _algorithm(data, parts[0])
        if name and name.startswith(ENCRYPTED):
            return ("encrypted_key", f"algorithm {name}", outer[2])
    if len(parts) in (2, 3) and _numbers(data, parts[:1]) == [3] and _algorithm(data, parts[1]) in STORES:
        return ("key_store", "pkcs12", outer[2])
    return None


def _ssh_key(data: bytes) -> tuple[str, str, int] | None:
    pos = len(SSH_MARK)

    def number():
        nonlocal pos
        if pos + 4 > len(data):
            raise ValueError
        pos += 4
        return int.from_bytes(data[pos - 4 : pos], "big")

    def part():
        nonlocal pos
        size = number()
        if pos + size > len(data):
            raise ValueError
        pos += size
        return data[pos - size : pos]

    try:
        cipher, kdf, _ = part(), part(), part()
        keys = number()
        public = []
        while len(public) < keys:
            public.append(part())
        private = part()
        end, name = pos, public[0][4 : 4 + int.from_bytes(public[0][:4], "big")]
    except (ValueError, IndexError):
        return None
    if len(private) < 16 or len(private) % 8 or not name or (cipher == b"none") != (kdf == b"none"):
        return None
    if cipher != b"none":
        return ("encrypted_key", f"openssh {cipher.decode('latin-1')}", end)
    # Both check numbers agree, and the private part names the key type that the public part names.
    if private[:4] != private[4:8] or private[12 : 12 + int.from_bytes(private[8:12], "big")] != name:
        return None
    return ("private_key", f"openssh {name.decode('latin-1')}", end)


def needed_bytes(head: bytes) -> int | None:
    """How many bytes the key that begins with ``head`` takes, as its outermost length says; -1 if only the whole tells, None: no key."""
    if head.startswith(SSH_MARK[: len(head)]) or head.startswith(SSH_MARK):
        return -1
    outer = der_at(head, 0, len(head))
    if outer is None or outer[0] != SEQUENCE or outer[2] < 24:
        return None
    inner = der_at(head, outer[1], len(head))
    if inner is None or inner[0] not in (INTEGER, SEQUENCE) or inner[2] > outer[2]:
        return None
    return outer[2]


def key_of(data: bytes) -> tuple[str, str, int] | None:
    """Kind, description and number of bytes of the key that ``data`` begins with."""
    return _ssh_key(data) if data.startswith(SSH_MARK) else _der_key(data)


def from_base64(text: str) -> bytes | None:
    """Bytes of base64 in either alphabet, with or without its padding."""
    text = text.rstrip("=").replace("-", "+").replace("_", "/")
    if len(text) % 4 == 1:
        return None
    try:
        return base64.b64decode(text + "=" * (-len(text) % 4), validate=True)
    except (binascii.Error, ValueError):
        return None


def _json_object(part: str) -> dict | None:
    data = from_base64(part)
    try:
        found = json.loads(data) if data else None
    except (ValueError, RecursionError):
        return None
    return found if isinstance(found, dict) else None


def token_of(parts: list[str]) -> str | None:
    """The algorithm of a signed (3 parts) or encrypted (5 parts) token; its header must say which it is."""
    header = _json_object(parts[0])
    if header is None or not isinstance(header.get("alg"), str):
        return None
    if len(parts) == 5:
        fits = isinstance(header.get("enc"), str) and all(from_base64(p) is not None for p in parts[1:]) and parts[2] and parts[3] and parts[4]
        return f"{header['alg']} {header['enc']}" if fits else None
    if "enc" in header or header["alg"].lower() == "none" or not parts[2] or from_base64(parts[2]) is None:
        return None
    payload = from_base64(parts[1])
    # A header may say that the payload is not encoded or is no JSON; a claim set is JSON.
    if payload is None or ("cty" not in header and _json_object(parts[1]) is None):
        return None
    return header["alg"]
