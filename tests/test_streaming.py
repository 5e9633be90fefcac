import numpy as np
import pandas as pd

from meridian.streaming.holding_age import holding_age

from .test_functions import long, same, wide


def test_ages_of_a_stream_match_the_recurrence(spark, tmp_path):
    rng = np.random.default_rng(3)
    turn = pd.DataFrame(rng.random((30, 5)), columns=list("abcde")).mask(rng.random((30, 5)) < 0.2)
    days = long(spark, turn, "turn")
    for part in (days.where("di < 12"), days.where("di >= 12")):  # two micro-batches
        part.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    late = days.where("di = 3")
    late.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(days.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    query = holding_age(stream).writeStream.format("memory").queryName("ages").outputMode("append").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "state")).start()
    query.awaitTermination()
    age, expected = 0, []
    for t in range(30):
        age = (1 - turn.iloc[t].fillna(0)) * (age + 1)
        expected.append(age)
    found = spark.table("ages")
    assert found.count() == 150
    same(wide(found, "age"), pd.DataFrame(expected).reset_index(drop=True))
