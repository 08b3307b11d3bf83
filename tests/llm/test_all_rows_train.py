"""The language network learns from every training row."""

from pyspark.sql import functions as F

from arbordiff.llm import language_model
from arbordiff.llm.common import Shared


def test_every_token_is_trained_on(spark):
    training = spark.range(0, 300, 1, 3).select("id", F.concat(F.lit("some words of row "), "id").alias("text"))
    words = language_model.vocabulary(language_model.count_tokens(training.select("text")))
    network = language_model.Network(words)
    before = network.p["class"].copy()
    assert language_model._average(training, network, Shared(spark, (words, network))) == words.total == 300 * 6
    assert (network.p["class"] != before).any()
