"""Sensor analytics for predictive maintenance, as Spark DataFrame operators."""

import sys

from pyspark import cloudpickle

from millwatch.plans.evaluate import Results, evaluate_scored, report_tables, save_document
from millwatch.plans.ingest import Ingested, ingest, ingest_csv
from millwatch.plans.prepare import Prepared, prepare, prepare_readings
from millwatch.plans.run import Run, run
from millwatch.plans.train import (
    Detectors, fit_detectors, freeze, load_detectors, save_detectors, score_detectors, score_saved,
    train_and_score,
)
from millwatch.session import clear_staging, local_session, staging
from millwatch.sources.csv_source import export_test_csv, load_csv
from millwatch.sources.results import load_results
from millwatch.sources.tables import ResultTables
from millwatch.streaming.scoring import score_stream, write_scores

__all__ = [
    "Detectors", "Ingested", "Prepared", "ResultTables", "Results", "Run", "clear_staging",
    "evaluate_scored", "export_test_csv", "fit_detectors", "freeze", "ingest", "ingest_csv",
    "load_csv", "load_detectors", "load_results", "local_session", "prepare", "prepare_readings",
    "report_tables", "run", "save_detectors", "save_document", "score_detectors", "score_saved",
    "score_stream", "staging", "train_and_score", "write_scores",
]

# Functions that run on workers travel with their code: workers need not have this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
