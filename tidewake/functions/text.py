"""What the text fields say, as Column expressions: statuses, destinations, document labels, port names, citations."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Texts that mean no value.
UNKNOWN_TEXTS = ["", "Unknown", "Unknown value", "Undefined"]
#: Statuses that claim movement, and that claim rest. Others claim nothing.
UNDER_WAY = ["Under way using engine", "Under way sailing", "Constrained by her draught", "Engaged in fishing", "Restricted maneuverability"]
STATIONARY = ["At anchor", "Moored", "Aground"]


def known_text(c: Column) -> Column:
    return F.when(~c.isin(UNKNOWN_TEXTS), c)


def reported_activity(status: Column) -> Column:
    return F.when(status.isin(UNDER_WAY), "UnderWay").when(status.isin(STATIONARY), "Stationary").otherwise("Unknown")


def normalise_destination(text: Column) -> Column:
    return F.upper(F.replace(text, F.lit(" "), F.lit("")))


def classify_destination(text: Column) -> Column:
    """Shape of a typed destination; the first that fits of Unreadable, ForOrders, Route, UnLocode, FreeText."""
    return (
        F.when(text.rlike("[^A-Za-z0-9><=\\-/.#,()&+'_:\" ]"), "Unreadable")
        .when(F.upper(text).contains("ORDER"), "ForOrders")
        .when(text.rlike("[><]"), "Route")
        .when(normalise_destination(text).rlike("^[A-Z]{2}[A-Z0-9]{3}$"), "UnLocode")
        .when(text.isNotNull(), "FreeText")
    )


#: Event kinds in order of trial, each with alternatives of which all words must occur.
SOF_RULES: list[tuple[str, list[list[str]]]] = [
    ("NoticeOfReadinessTendered", [["notice", "readiness"], ["nor", "tender"], ["nor", "receiv"], ["nor", "accept"]]),
    ("AnchorAweigh", [["anchor", "aweigh"], ["weigh", "anchor"], ["anchor", "up"]]),
    ("Anchored", [["drop", "anchor"], ["anchored"], ["arrived", "anchorage"]]),
    ("LeftBerth", [["left berth"], ["last line"], ["unmoor"], ["vessel", "sailed"]]),
    ("AllFast", [["all fast"], ["vessel", "moored"], ["moored", "alongside"]]),
    ("FirstLineAshore", [["first line"], ["first rope"]]),
    ("CargoCompleted", [["complet", "discharg"], ["complet", "load"], ["complet", "cargo"], ["finish", "cargo"]]),
    ("CargoCommenced", [["commenc", "discharg"], ["commence", "discharg"], ["commenc", "load"], ["commence", "load"], ["commenc", "cargo"], ["start", "cargo"]]),
    ("Resumed", [["resumed"], ["recommenc"], ["restart"]]),
    ("Suspended", [["suspend"], ["stoppage"], ["shore", "stop"]]),
    ("EndOfSeaPassage", [["end of sea passage"], ["eosp"]]),
    ("StartOfSeaPassage", [["start of sea passage"], ["sosp"]]),
]


def classify_sof_event(label: Column) -> Column:
    low = F.lower(F.trim(label))
    out = F.lit("Other")
    for kind, alternatives in reversed(SOF_RULES):
        hit = F.lit(False)
        for words in alternatives:
            every = F.lit(True)
            for w in words:
                every = every & low.contains(w)
            hit = hit | every
        out = F.when(hit, kind).otherwise(out)
    return F.when(low.isNull() | (low == ""), "Other").otherwise(out)


def fold_port_name(name: Column) -> Column:
    """Lower case, letters and digits only, letters of the gazetteer's languages unaccented."""
    low = F.lower(name)
    for letter, plain in (("å", "aa"), ("æ", "ae"), ("ß", "ss")):
        low = F.replace(low, F.lit(letter), F.lit(plain))
    low = F.translate(low, "øäöüąćęłńóśźż", "oaouacelnoszz")
    return F.regexp_replace(low, r"[^\p{L}\p{Nd}]", "")


def port_names_agree(document: Column, ais: Column) -> Column:
    """Null where either is missing; one containing the other counts."""
    a, b = fold_port_name(document), fold_port_name(ais)
    return F.when(document.isNotNull() & (document != "") & ais.isNotNull(), F.contains(a, b) | F.contains(b, a))


CITATION = r"\[r(\d{1,18})[·.]L(\d{1,18})\]"


def citation(run_id: Column, source_line: Column) -> Column:
    return F.format_string("[r%d·L%d]", run_id.cast("long"), source_line.cast("long"))


def citations_in(text: Column) -> Column:
    """All citations of a text in order, in their canonical form."""
    return F.transform(F.regexp_extract_all(text, F.lit(f"({CITATION})"), F.lit(1)), lambda c: F.regexp_replace(c, r"\]?\.L", "·L"))


def prorate_minor(rate_minor: Column, part: Column, whole: int) -> Column:
    """rate * part / whole in minor units, half away from zero, in exact decimals."""
    product = rate_minor.cast("decimal(19,0)") * part.cast("decimal(18,0)")
    return F.round(product.cast("decimal(38,0)") / F.lit(whole).cast("decimal(12,0)"), 0).cast("bigint")


def cargo_movement(first_m: Column, last_m: Column, dead_band_m: float = 0.5) -> Column:
    """What the change of draught says; a change within the dead band, edge included, is none."""
    change = last_m - first_m
    return F.when(change.isNull(), "Unknown").when(F.abs(change) <= dead_band_m, "Unchanged").when(change < 0, "Discharged").otherwise("Loaded")


def hours_text(hours: Column, exact: Column) -> Column:
    """Hours with one decimal; a lower bound is marked as one and never shown as a measurement."""
    return F.concat(F.when(exact, "").otherwise(">="), F.format_string("%.1f", hours))


def drift_text(drift_nm: Column) -> Column:
    """Drift with three decimals, or ? where it means nothing."""
    return F.when(drift_nm.isNull(), "?").otherwise(F.format_string("%.3f", drift_nm))


def port_text(port: Column, distance_nm: Column, at_port: Column) -> Column:
    """A port with its distance; a tilde marks one that is too far off to be the port's own."""
    return F.when(port.isNull(), "(none named)").otherwise(F.concat(F.when(at_port, "").otherwise("~"), port, F.lit(" "), F.format_string("%.1f", distance_nm), F.lit(" nm")))
