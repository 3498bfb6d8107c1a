"""The export: one JSON folder per section, written by Spark."""

from __future__ import annotations

from pyspark.sql import DataFrame

from . import reports
from .laytime import priceability
from .rules import registry
from .thresholds import Thresholds, thresholds_table


def export_sections(store, th: Thresholds = Thresholds()) -> dict[str, DataFrame]:
    """Name to DataFrame of every section. Consumers are never paged."""
    from .annotate import annotate

    spark, stops, calls, phases, vessels = store.spark, store.table("stop_event"), store.table("port_call"), store.table("port_call_phase"), store.table("vessel")
    fixes, _ = annotate(store.positions())
    counts = reports.destination_counts(fixes)
    bins, bands, eta = reports.eta_horizon(fixes, th)
    return {
        "manifest": reports.manifest(store.runs()),
        "summary": reports.detection_summary(stops, calls),
        "habits": reports.habits(stops, th),
        "rules": reports.quality_report(registry(spark, th), store.quarantine(), fixes),
        "status_disagreement": reports.status_disagreement(stops),
        "vessels": reports.vessel_records(stops, fixes, vessels),
        "ports": reports.port_benchmarks(calls, th),
        "port_observations": reports.port_observations(calls, th),
        "priceability": priceability(phases),
        "thresholds": thresholds_table(spark, th),
        "eta_bins": bins,
        "eta_bands": bands,
        "eta": eta,
        "destinations": counts,
        "destination_summary": reports.destination_summary(counts),
        "destination_typists": reports.destination_typists(fixes),
        "cargo": reports.reported_cargo(calls),
    }


def export(store, path: str, th: Thresholds = Thresholds(), only: list[str] | None = None) -> list[str]:
    """Writes all sections, or those named."""
    sections = {k: v for k, v in export_sections(store, th).items() if only is None or k in only}
    for name, df in sections.items():
        df.write.mode("overwrite").json(f"{path.rstrip('/')}/{name}")
    return list(sections)
