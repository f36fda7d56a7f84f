"""The whole way from readings to results."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from millwatch.plans.evaluate import Results, evaluate_scored, save_document, store_results
from millwatch.plans.ingest import Ingested, ingest, ingest_csv
from millwatch.plans.prepare import Prepared, prepare
from millwatch.plans.train import Detectors, load_detectors, save_detectors, score_prepared, train_and_score
from millwatch.sources.tables import ResultTables


@dataclass(frozen=True)
class Run:
    batch: Ingested
    prepared: Prepared
    detectors: Detectors
    results: Results


def run(
    spark: SparkSession,
    source: DataFrame | str,
    tables: ResultTables | None = None,
    document: str | None = None,
    models: str | None = None,
    pretrained: str | None = None,
    ingest_options: dict | None = None,
    **training,
) -> Run:
    """Ingest, prepare, train (or load detectors), evaluate, store.

    ``tables`` takes the rows, ``document`` and ``models`` are folders for the
    result document and the fitted detectors; each is optional.  A ``pretrained`` run
    fits nothing: gaps, scaling, explanations and stored statistics are those of the
    table that the detectors were trained on.
    """
    take = ingest_csv if isinstance(source, str) else (lambda _, df, **o: ingest(df, **o))
    batch = take(spark, source, tables=tables, **(ingest_options or {}))
    if pretrained is None:
        prepared = prepare(batch, tables)
        detectors, scored = train_and_score(prepared, **training)
    else:
        detectors = load_detectors(spark, pretrained)
        if set(detectors.features) != set(batch.features):
            raise ValueError(
                f"The saved detectors read {sorted(detectors.features)}, the table has {sorted(batch.features)}."
            )
        if detectors.stats is None:
            raise ValueError(f"The detectors in {pretrained} were saved without the statistics of their train part.")
        prepared = prepare(batch, tables, saved=(detectors.medians, detectors.stats))
        scored = score_prepared(prepared, detectors)
    results = evaluate_scored(
        scored, prepared.stats, detectors.thresholds,
        status=detectors.status, notes=detectors.notes,
    )
    if models is not None:
        save_detectors(spark, detectors, models)
    if tables is not None:
        store_results(results, tables, prepared.run_id, batch.batch_id)
    if document is not None:
        save_document(
            spark, results, document,
            run_id=prepared.run_id, batch_id=batch.batch_id, source_file=batch.source,
            feature_columns=list(batch.features),
            missing_feature_columns=list(batch.missing), warnings=list(batch.notes),
        )
    return Run(batch, prepared, detectors, results)
