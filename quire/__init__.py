"""Page pipeline for large collections of converted documents, on Spark."""

from quire.operators.convert import Render, RunOptions, convert
from quire.plans.documents import documents
from quire.plans.run import RunReport, preview, run

__all__ = ["Render", "RunOptions", "RunReport", "convert", "documents", "preview", "run"]
