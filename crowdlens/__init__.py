"""crowdlens: PySpark operators for user reviews, contributor risk and multi-label text baselines."""

from crowdlens.params import LabelParams, QueueParams, TextParams
from crowdlens.session import get_spark, stage

__all__ = ["LabelParams", "QueueParams", "TextParams", "get_spark", "stage"]
