"""Column functions over packets, ports and addresses."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from flowsentry import dims


def flag_bits(letters: Column) -> Column:
    """TCP flag letters ("SA") -> the flag byte."""
    bits = [F.when(letters.contains(f), 1 << i).otherwise(0) for i, f in enumerate(dims.TCP_FLAGS)]
    return F.coalesce(sum(bits[1:], bits[0]), F.lit(0))


def flag_letters(bits: Column, ordered: str = dims.TCP_FLAGS) -> Column:
    """Flag byte -> letters, in the given letter order (lowest bit first by default)."""
    return F.concat(
        *[F.when(bits.bitwiseAND(F.lit(1 << dims.TCP_FLAGS.index(f))) != 0, f).otherwise("") for f in ordered]
    )


def protocol_name(protocol: Column, other: Column | None = None) -> Column:
    return lookup(protocol, dims.PROTOCOLS, protocol.cast("string") if other is None else other)


def once(expression: Column) -> Column:
    """Evaluates a struct once per row; its fields become columns.

    Several columns built from one long expression would each repeat it after the
    optimizer merges projections; a generator keeps it in one place.
    """
    return F.inline(F.array(expression))


def is_well_known(port: Column) -> Column:
    return port < 1024


def is_registered(port: Column) -> Column:
    return (port >= 1024) & (port < 49152)


def is_ephemeral(port: Column) -> Column:
    return port >= 49152


def is_internal(ip: Column) -> Column:
    """RFC 1918 address; anything that is not dotted numbers is not internal."""
    part = F.split(ip, r"\.")
    first, second = F.try_element_at(part, F.lit(1)).try_cast("int"), F.try_element_at(part, F.lit(2)).try_cast("int")
    return F.coalesce(
        (first == 10) | ((first == 172) & second.between(16, 31)) | ((first == 192) & (second == 168)), F.lit(False)
    )


def lookup(key: Column, table: dict, default=None) -> Column:
    """Value of ``key`` in a small fixed table, as one map literal."""
    found = F.try_element_at(F.create_map(*[F.lit(x) for pair in table.items() for x in pair]), key)
    if default is None:
        return found
    return F.coalesce(found, default if isinstance(default, Column) else F.lit(default))


def port_service(port: Column) -> Column:
    """Service name of a watched port; sensitive names go before bad-port names."""
    return lookup(port, {**dims.CAPTURE_BAD_PORTS, **dims.CAPTURE_SENSITIVE_PORTS}, "")


def port_label(port: Column) -> Column:
    return F.concat(F.lit(":"), port.cast("string"), F.lit(" ("), port_service(port), F.lit(")"))
