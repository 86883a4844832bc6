import os
import sys
import tempfile
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
os.environ.setdefault("TZ", "UTC")


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    s = (
        SparkSession.builder.master("local[4]").appName("tests").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "4g").config("spark.ui.showConsoleProgress", "false")
        .config("spark.checkpoint.dir", "file://" + tempfile.mkdtemp(prefix="cadenza-tests-")).getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


SEGMENT = (
    "seg_uid bigint, workspace_id string, language_pair string, idx bigint, seg_id string, speaker string, start_s double, end_s double, source_text string, target_text string, target_lang string, "
    "glossary_hits array<string>, timing struct<slot_duration_s:double,estimated_duration_s:double,score:double>, render_key string, is_non_speech boolean, ingested_at timestamp"
)


@pytest.fixture()
def segments(spark):
    """Rows of the segment table from dictionaries; what is left out is null."""
    names = [c.split()[0] for c in SEGMENT.replace(",estimated", ";estimated").replace(",score", ";score").split(", ")]

    def make(rows):
        return spark.createDataFrame([tuple(r.get(n) for n in names) for r in rows], SEGMENT)

    return make
