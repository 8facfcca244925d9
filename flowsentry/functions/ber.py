"""A cursor over tag-length-value elements (ITU-T X.690) and the two message shapes that name people.

Tags are numbers as they stand in the first octets: 0x30 is a sequence, 0xA1 the constructed context tag 1. Lengths may have
one octet or several; an element that says it is longer than what is there is not one.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

# ---- Fixed values: tags of RFC 4120 and RFC 4511 ---------------------------------------
SEQUENCE, SET, OCTETS, GENERAL_STRING, VISIBLE_STRING = 0x30, 0x31, 0x04, 0x1B, 0x1A
AS_REQUEST, REQUEST_BODY, CLIENT_NAME, NAME_PARTS = 0x6A, 0xA4, 0xA1, 0xA1
SEARCH_ENTRY = 0x64


class Element(NamedTuple):
    tag: int
    value: bytes
    end: int  # place behind it in the data it was read from

    @property
    def children(self) -> Iterator[Element]:
        return elements(self.value)

    def child(self, *tags: int) -> Element | None:
        """The element reached by taking the first child of each tag in turn."""
        here: Element | None = self
        for tag in tags:
            here = next((e for e in here.children if e.tag == tag), None)
            if here is None:
                return None
        return here


def element(data: bytes, at: int = 0) -> Element | None:
    """The element that starts at ``at``; None if no whole one does."""
    if at >= len(data):
        return None
    tag, at = data[at], at + 1
    if tag & 0x1F == 0x1F:  # the number goes on while the high bit is set
        more = True
        while more and at < len(data):
            tag, more, at = tag << 8 | data[at], data[at] & 0x80, at + 1
    if at >= len(data):
        return None
    size, at = data[at], at + 1
    if size & 0x80:
        octets = size & 0x7F
        if not 1 <= octets <= 4 or at + octets > len(data):  # no indefinite lengths in these protocols
            return None
        size, at = int.from_bytes(data[at : at + octets], "big"), at + octets
    return Element(tag, data[at : at + size], at + size) if at + size <= len(data) else None


def elements(data: bytes) -> Iterator[Element]:
    """Elements one behind the other, up to the first place where none starts."""
    at = 0
    while (found := element(data, at)) is not None:
        yield found
        at = found.end


def strings(data: bytes, tags: tuple[int, ...], depth: int = 16) -> Iterator[bytes]:
    """Values of elements with one of ``tags``, in order, inside constructed elements too."""
    for e in elements(data):
        if e.tag in tags:
            yield e.value
        elif depth and e.tag & 0x20 and e.tag < 256:
            yield from strings(e.value, tags, depth - 1)


def client_names(data: bytes) -> Iterator[bytes]:
    """Parts of the client's name in Kerberos requests for a ticket; of other messages, and of what is no message, all strings."""
    messages = [element(data, start) for start in (0, 4)]  # over TCP four octets of length go before the message
    request = next((m for m in messages if m is not None and m.tag == AS_REQUEST), None)
    if request is not None:
        parts = request.child(SEQUENCE, REQUEST_BODY, SEQUENCE, CLIENT_NAME, SEQUENCE, NAME_PARTS, SEQUENCE)
        yield from (e.value for e in parts.children if e.tag == GENERAL_STRING) if parts else ()
        return
    for start in (0, 4):
        found = list(strings(data[start:], (GENERAL_STRING, VISIBLE_STRING)))
        if found:
            yield from found
            return


def entry_attributes(data: bytes) -> Iterator[tuple[bytes, list[bytes]]]:
    """(type, values) of all attributes of the LDAP search results in ``data``."""
    for message in elements(data):
        entry = message.child(SEARCH_ENTRY) if message.tag == SEQUENCE else None
        attributes = entry.child(SEQUENCE) if entry else None
        for attribute in attributes.children if attributes else ():
            name, values = attribute.child(OCTETS), attribute.child(SET)
            if name and values:
                yield name.value, [v.value for v in values.children]


def values_behind(data: bytes, name: bytes) -> Iterator[bytes]:
    """For pieces of a message: values in the elements right behind each place where ``name`` stands."""
    at = data.find(name)
    while at >= 0:
        follows = element(data, at + len(name))
        if follows is not None and follows.tag in (SET, OCTETS):
            yield from [e.value for e in follows.children if e.tag == OCTETS] if follows.tag == SET else [follows.value]
        at = data.find(name, at + len(name))
