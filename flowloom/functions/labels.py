"""Protocol and label normalising."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, functions as F

# Protocol numbers, family names, predicate terms.
PROTOCOLS = {"6": "tcp", "17": "udp", "1": "icmp"}
BOTNET_TERMS = ("botnet", "c&c", "cc", "bot")
MALWARE_TERMS = BOTNET_TERMS + ("malware",)


def protocol(col: Column, upper: bool = False) -> Column:
    """tcp / udp / icmp from a number or a name; other values pass through."""
    name = F.lower(F.trim(col))
    known = F.create_map(*[F.lit(x) for pair in PROTOCOLS.items() for x in pair])
    result = F.coalesce(F.try_element_at(known, name), name)
    return F.upper(result) if upper else result


def attack_family(col: Column, wide: bool = True) -> Column:
    """Long ground-truth label -> family. The order of the rules matters."""
    label = F.trim(col)
    upper = F.upper(label)
    ddos = label.startswith("DDoS")
    brute = label.contains("Patator")
    if wide:
        ddos = ddos | label.startswith("DDOS")
        brute = (
            brute
            | label.contains("BruteForce")
            | label.contains("Bruteforce")
            | (upper.contains("BRUTE") & (upper.contains("FTP") | upper.contains("SSH")))
        )
    return (
        F.when(upper == "BENIGN", "Benign")
        .when(label.startswith("DoS"), "DoS")
        .when(ddos, "DDoS")
        .when(label.contains("Web Attack") | label.contains("Web attack"), "WebAttack")
        .when(label.startswith("Infiltration"), "Infiltration")
        .when(label.startswith("Bot"), "Bot")
        .when(brute, "BruteForce")
        .otherwise(label)
    )


def mentions(col: Column, terms: Sequence[str] = BOTNET_TERMS) -> Column:
    """True when the label contains any term, ignoring case; null is False."""
    lowered = F.lower(F.coalesce(col, F.lit("")))
    hit = F.lit(False)
    for term in terms:
        hit = hit | lowered.contains(term)
    return hit


def traffic_kind(col: Column, terms: Sequence[str] = BOTNET_TERMS) -> Column:
    """Matched label -> botnet, normal or background; no label -> unmatched."""
    return (
        F.when(col.isNull(), "unmatched")
        .when(mentions(col, terms), "botnet")
        .when(F.lower(col).contains("normal"), "normal")
        .otherwise("background")
    )


def remap(col: Column, mapping: Mapping[str, str]) -> Column:
    """Class remap; labels outside the mapping stay as they are."""
    pairs = F.create_map(*[F.lit(x) for pair in mapping.items() for x in pair])
    return F.coalesce(F.try_element_at(pairs, col), col)
