import struct

import pytest

from flowsentry.functions import ber
from flowsentry.operators import identity as idn


def tlv(tag, content):
    n = len(content)
    size = bytes([n]) if n < 128 else bytes([0x81, n]) if n < 256 else b"\x82" + struct.pack("!H", n)
    return bytes([tag]) + size + content


def as_request(name=b"jane.doe", padding=b"", realm=b"CORP", typed=0x6A):
    person = tlv(0xA1, tlv(0x30, tlv(0xA0, b"\x02\x01\x01") + tlv(0xA1, tlv(0x30, tlv(0x1B, name))))) if name else b""
    service = tlv(0xA3, tlv(0x30, tlv(0xA1, tlv(0x30, tlv(0x1B, b"krbtgt") + tlv(0x1B, b"svc1")))))
    body = tlv(0xA4, tlv(0x30, tlv(0xA0, b"\x03\x05\x00\x40\x81\x00\x10") + person + tlv(0xA2, tlv(0x1B, realm)) + service))
    return tlv(typed, tlv(0x30, tlv(0xA1, b"\x02\x01\x05") + tlv(0xA3, tlv(0x30, tlv(0x04, padding))) + body))


def entry(*attributes):
    parts = b"".join(tlv(0x30, tlv(0x04, name) + tlv(0x31, b"".join(tlv(0x04, v) for v in values))) for name, values in attributes)
    return tlv(0x30, b"\x02\x01\x07" + tlv(0x64, tlv(0x04, b"cn=x") + tlv(0x30, parts)))


@pytest.mark.parametrize("n", [0, 1, 127, 128, 255, 256, 70_000])
def test_lengths_of_any_size(n):
    data = b"\x04" + (bytes([n]) if n < 128 else b"\x84" + struct.pack("!I", n)) + b"z" * n
    assert ber.element(data + b"rest") == (0x04, b"z" * n, len(data))
    assert ber.element(data[:-1]) is None


def test_broken_elements():
    for data in (b"", b"\x30", b"\x30\x80\x00\x00", b"\x30\x85\x01", b"\x1f\x81", b"\x04\x05abc"):
        assert ber.element(data) is None
    assert ber.element(b"\x7f\x81\x01\x01Z").value == b"Z"
    assert [e.value for e in ber.elements(b"\x04\x01a\x04\x01b\x04\x09c")] == [b"a", b"b"]


@pytest.mark.parametrize("padding", [b"", b"\x1b\x05evil1", b"p" * 200, b"p" * 40_000])
@pytest.mark.parametrize("over_tcp", [False, True])
def test_client_name_not_what_looks_like_one(padding, over_tcp):
    data = as_request(padding=padding)
    data = struct.pack("!I", len(data)) + data if over_tcp else data
    assert [v for _, v, _ in idn._kerberos(data)] == ["jane.doe"]


def test_kerberos_without_a_person():
    assert list(idn._kerberos(as_request(name=None))) == []
    assert list(idn._kerberos(as_request(name=b"guest"))) == []
    assert list(idn._kerberos(b"\x00\x01 no message")) == []
    assert [v for _, v, _ in idn._kerberos(as_request(b"x" * 63))] == ["x" * 63] and list(idn._kerberos(as_request(b"x" * 64))) == []


def test_ldap_entries():
    big = (b"objectClass", [b"top", b"q" * 500])
    got = dict((f, v) for f, v, _ in idn._ldap(entry(big, (b"CN", [b"Common Name"]), (b"displayName", ["Zoë Miller".encode()]), (b"sAMAccountName", [b"zoem"]))))
    assert got == {"fullname": "Zoë Miller", "username": "zoem"}
    assert [v for _, v, _ in idn._ldap(entry((b"displayName", [b"R2D2", b"Jane Doe"])) + entry((b"cn", [b"Other"])))] == ["Jane Doe"]
    assert [v for _, v, _ in idn._ldap(entry((b"displayName", [b"R2D2"]), (b"cn", [b"Jane Doe"])))] == ["Jane Doe"]


def test_ldap_pieces_and_searches():
    piece = entry((b"displayName", [b"Jane Doe"]))[9:]
    assert [v for _, v, _ in idn._ldap(piece)] == ["Jane Doe"]
    asked = tlv(0x30, b"\x02\x01\x07" + tlv(0x63, tlv(0x30, tlv(0x04, b"displayName") + tlv(0x04, b"x1"))))
    assert list(idn._ldap(asked)) == []
