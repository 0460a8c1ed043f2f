"""Files of the model or of the digests that are gone are an error, never a count of zero."""

import glob
import os

import pytest
from pyspark.sql import functions as F

from sparloom.llm import common, lm_scoring, substring_dedup


def test_a_lost_file_of_the_model_is_an_error(spark, documents):
    few = documents.limit(60)
    model = lm_scoring.train_model(few.select("text"))
    whole = lm_scoring.score(few, model).agg(F.sum("score")).first()[0]
    assert whole < 0
    for kind in ("words", "pairs"):
        path = glob.glob(f"{model.vocabulary.folder}/{kind}-*.npy")[0]
        os.rename(path, f"{path}.away")
        with pytest.raises(Exception, match="No such file"):
            lm_scoring.score(few, model).collect()
        os.rename(f"{path}.away", path)
    assert lm_scoring.score(few, model).agg(F.sum("score")).first()[0] == pytest.approx(whole)


def test_a_lost_file_of_digests_is_an_error(spark, documents, monkeypatch):
    built = substring_dedup.repeated

    def losing(texts, digests_of, folder, name):
        found = built(texts, digests_of, folder, name)
        if name == lost:
            for path in glob.glob(f"{folder}/{name}-*.npy"):
                os.rename(path, f"{path}.away")
        return found

    monkeypatch.setattr(substring_dedup, "repeated", losing)
    for lost in ("chunks", "windows"):
        with pytest.raises(Exception, match="No such file"):
            substring_dedup.passages(documents).collect()


def test_clean_up_leaves_nothing(spark, documents):
    path = common.own_dir(spark).removeprefix("file://")
    kept = common.materialize(documents.limit(5), "some")
    assert kept.count() == 5 and glob.glob(f"{path}/some-*")
    common.clean_up(spark)
    assert not os.path.exists(path)


def test_a_cluster_without_a_shared_folder_is_an_error():
    class Context:
        master = "spark://host:7077"

        @staticmethod
        def getConf():
            return {}

    class Session:
        sparkContext = Context

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        common.shared_dir(Session)
