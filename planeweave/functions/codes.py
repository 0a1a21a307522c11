"""Identities, addresses and tunnel keys as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Element ids that carry tunnel keys.
CREATED_PDR, F_TEID = 8, 21
UPDATE_FAR, FORWARDING, OUTER_HEADER = 10, 11, 84
UP_TRANSPORT_IE = 139


def bcd_digits(raw: Column) -> Column:
    """Digits of a BCD field, low nibble first, 0xF filler dropped.

    A nibble A-E is no digit; such a field gives null.
    """
    swapped = F.regexp_replace(F.hex(raw), "(.)(.)", "$2$1")
    digits = F.regexp_replace(swapped, "F", "")
    return F.when(digits.rlike("^[0-9]*$"), digits)


def supi_from_suci(scheme: Column, plmn: Column, msin: Column) -> Column:
    """The plaintext identity of a null-scheme SUCI, else null."""
    return F.when(scheme == 0, F.concat(bcd_digits(plmn), bcd_digits(msin)))


def guti(plmn: Column, region: Column, set_id: Column, pointer: Column, tmsi: Column) -> Column:
    """`plmn-region-set-ptr-tmsi`, evidence only."""
    parts = [bcd_digits(plmn), *[c.cast("string") for c in (region, set_id, pointer, tmsi)]]
    return F.concat(*[p for part in parts for p in (F.lit("-"), part)][1:])


def session_cause(container: Column, carrier: Column) -> Column:
    """The cause inside a transport container is the specific one."""
    return F.coalesce(container, carrier)


def ip_text(raw: Column) -> Column:
    """Dotted quad for 4 bytes, shortest colon form for 16 bytes, else null."""
    def byte(i: int) -> Column:
        return F.conv(F.hex(F.substring(raw, i, 1)), 16, 10)

    quad = F.concat_ws(".", *[byte(i) for i in range(1, 5)])
    return F.when(F.length(raw) == 4, quad).when(F.length(raw) == 16, _colon_form(raw))


def _colon_form(raw: Column) -> Column:
    """RFC 5952 text: lower-case groups, the first longest run of zeros folded.

    Addresses that embed an IPv4 address (::a.b.c.d and ::ffff:a.b.c.d) print it
    as a quad.
    """
    groups = F.transform(
        F.sequence(F.lit(1), F.lit(15), F.lit(2)),
        lambda i: F.lower(F.conv(F.hex(F.substring(raw, i, 2)), 16, 16)))
    text = F.array_join(groups, ":")
    padded = F.concat(F.lit(":"), text, F.lit(":"))
    folded = padded
    # The longest run of zero groups that occurs; the first of its length wins.
    for n in range(2, 9):
        run = ":" + "0:" * n
        spot = F.instr(padded, run)
        folded = F.when(spot > 0, F.concat(
            F.substring(padded, F.lit(1), spot), F.lit("X"),
            F.substring(padded, spot + len(run) - 1, F.lit(100)))).otherwise(folded)
    inner = F.regexp_replace(F.regexp_replace(folded, "^:(?!X)", ""), "(?<!X):$", "")
    plain = F.replace(F.replace(F.replace(inner, F.lit(":X:"), F.lit("::")),
                                F.lit("X:"), F.lit(":")), F.lit("X"), F.lit(""))
    quad = F.concat_ws(".", *[F.conv(F.hex(F.substring(raw, i, 1)), 16, 10)
                              for i in range(13, 17)])
    head, high = F.hex(F.substring(raw, 1, 12)), F.hex(F.substring(raw, 13, 2))
    return (F.when(head == "0" * 20 + "FFFF", F.concat(F.lit("::ffff:"), quad))
            .when((head == "0" * 24) & (high != "0000"), F.concat(F.lit("::"), quad))
            .otherwise(plain))


def _tunnels(found: Column) -> Column:
    """Keep complete (teid, ip) pairs only."""
    return F.filter(found, lambda t: t.teid.isNotNull() & t.ip.isNotNull())


def n2_tunnels(request_items: Column, response_items: Column) -> Column:
    """Tunnels an N2 message declares.

    `request_items`: array of set-up items, each an array of
    struct<id, teid, ip> protocol elements; only the user-plane transport element
    counts.  `response_items`: array of items, each an array of downlink
    struct<teid, ip>.
    """
    asked = F.flatten(F.transform(request_items, lambda item: F.transform(
        F.filter(item, lambda ie: ie.id == UP_TRANSPORT_IE),
        lambda ie: F.struct(ie.teid.alias("teid"), ie.ip.alias("ip")))))
    answered = F.flatten(response_items)
    none = F.array().cast("array<struct<teid:bigint,ip:string>>")
    return _tunnels(F.concat(F.coalesce(asked, none), F.coalesce(answered, none)))


def n4_tunnels(ies: Column) -> Column:
    """Tunnel keys of an N4 message.

    `ies`: array of struct<path array<int>, gtp boolean, teid, ip>, one per
    decoded leaf with the element types from the top level down.  Created-PDR
    endpoints and the GTP-U outer headers of Update-FAR forwarding are keys;
    endpoints of Create-PDR or Create-FAR are placeholders.
    """
    created = F.array(F.lit(CREATED_PDR), F.lit(F_TEID))
    updated = F.array(F.lit(UPDATE_FAR), F.lit(FORWARDING), F.lit(OUTER_HEADER))
    keyed = F.filter(ies, lambda ie: (ie.path == created)
                     | ((ie.path == updated) & F.coalesce(ie.gtp, F.lit(False))))
    return _tunnels(F.transform(
        keyed, lambda ie: F.struct(ie.teid.alias("teid"), ie.ip.alias("ip"))))
