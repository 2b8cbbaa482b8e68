"""Feature catalogs -> modality datasets -> named views."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def catalog_entries(catalog: DataFrame) -> list[tuple[str, str]]:
    """(Feature, Grouping) in catalog order. A catalog is metadata (one row per feature);
    only these names reach the driver, never data rows."""
    rows = (catalog.withColumn("__pos", F.monotonically_increasing_id())
            .orderBy("__pos").select("Feature", "Grouping").collect())
    return [(r[0], r[1]) for r in rows]


def catalog_features(catalog: DataFrame | list, groups: list[str]) -> list[str]:
    """Feature names whose Grouping is in ``groups``, in catalog order, duplicates removed."""
    entries = catalog if isinstance(catalog, list) else catalog_entries(catalog)
    out = []
    for f, g in entries:
        if g in groups and f not in out:
            out.append(f)
    return out


def feature_subset(data: DataFrame, catalog, groups: list[str], key: str = "row_id",
                   label: str = "DX") -> DataFrame:
    """Project ``data`` onto the catalog features of ``groups`` (+ key, label last).
    Features absent from ``data`` are ignored."""
    present = {c.lower(): c for c in data.columns}
    feats = [present[f.lower()] for f in catalog_features(catalog, groups)
             if f.lower() in present and present[f.lower()] not in (key, label)]
    return data.select(key, *feats, label)


def modality_datasets(data: DataFrame, catalog: DataFrame, modalities: dict[str, list[str]],
                      key: str = "row_id", label: str = "DX") -> dict[str, DataFrame]:
    entries = catalog_entries(catalog)
    return {name: feature_subset(data, entries, groups, key, label) for name, groups in modalities.items()}


def dataset_views(datasets: dict[str, DataFrame], views: dict[str, list[str]], key: str = "row_id",
                  label: str = "DX") -> dict[str, DataFrame]:
    """Named views = keyed column concatenation of base datasets, one label kept.

    All base datasets are projections of one keyed table, so a view is a 1:1 inner join on
    the key (AQE turns matching keys into a co-partitioned sort-merge or broadcast join).
    """
    from foldwise.operators.joins import align_by_row
    out = dict(datasets)
    for name, parts in views.items():
        joined = align_by_row([datasets[p] for p in parts], key, label)
        feats = [c for c in joined.columns if c not in (key, label)]
        out[name] = joined.select(key, *feats, label)
    return out


def choose_datasets(datasets: dict[str, DataFrame], names: list[str]) -> list[tuple[str, DataFrame]]:
    """Ordered (name, dataset) list for one experiment; repeats allowed."""
    return [(n, datasets[n]) for n in names]


def features_of(df: DataFrame, key: str = "row_id", label: str = "DX") -> list[str]:
    return [c for c in df.columns if c not in (key, label, "fold")]
