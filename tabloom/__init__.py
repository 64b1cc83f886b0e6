"""tabloom: the data side of a tabular modelling workflow, written as Spark jobs.

Layout
------
sources/    loading CSV/Parquet, prediction exports, run artifacts, model save/load
functions/  row-local column expressions (hashes, lenient date parsing, numeric rules)
operators/  distributed work: profiling, exact ranks and splits, fitted feature
            preparation, models, baselines, metrics, grid search
plans/      driver-side decisions over bounded inputs: override rules, feature plans,
            recommendation rules, the end-to-end workflow
streaming/  stateless scoring of a stream with a fitted preparation + model
"""

from tabloom.session import get_spark, checkpoint_dir, cut_lineage

__all__ = ["get_spark", "checkpoint_dir", "cut_lineage"]
