"""Stored tables on plain Parquet, partitioned by month.

Four tables: ``scrapes``, ``stories``, ``links`` (story to scrape) and ``figures`` (what searches
need to know of a month, kept up by signed changes). An ingest stages
all its outputs in the shared folder first, records them in a commit note, and only then
replaces the touched month partitions, by moving the staged ones to their place. A run that dies
half-way leaves the note behind, and opening the store applies it again, so the tables never stay apart.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import EngineConfig
from ..functions import ids
from ..operators import counts, figures, quality, search, upsert
from ..schema import SCRAPES
from ..session import configure
from ..sources import backup, stored
from . import front_page, merge
from . import stories as st

_STORIES = """shard INT, story_id STRING, url STRING, host STRING, url_norm STRING,
    title STRING, date TIMESTAMP, score DOUBLE, tags ARRAY<STRING>, n_scrapes BIGINT,
    sources MAP<STRING, STRING>, self_post BOOLEAN"""
_LINKS = "shard INT, story_id STRING, scrape_shard INT, scrape_id STRING"
SCHEMAS = {"scrapes": SCRAPES, "stories": _STORIES, "links": _LINKS, "figures": figures.SCHEMA}
_NULL = "__HIVE_DEFAULT_PARTITION__"  # the folder of rows without a month


class StoryStore:
    def __init__(self, spark: SparkSession, root: str, cfg: EngineConfig = EngineConfig()):
        self.spark, self.root, self.cfg = configure(spark), root.rstrip("/"), cfg
        self._recover()

    # -- files ------------------------------------------------------------------------
    def _path(self, *parts: str):
        jvm = self.spark._jvm
        path = jvm.org.apache.hadoop.fs.Path("/".join((self.root, *parts)))
        return path, path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _exists(self, *parts: str) -> bool:
        path, fs = self._path(*parts)
        return fs.exists(path)

    def _delete(self, *parts: str) -> None:
        path, fs = self._path(*parts)
        fs.delete(path, True)

    # -- tables -----------------------------------------------------------------------
    def table(self, name: str) -> DataFrame:
        schema = SCHEMAS[name]
        if not self._exists(name):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(f"{self.root}/{name}")

    @property
    def scrapes(self) -> DataFrame:
        return self.table("scrapes")

    @property
    def stories(self) -> DataFrame:
        return self.table("stories")

    @property
    def links(self) -> DataFrame:
        return self.table("links")

    @property
    def figures(self) -> DataFrame:
        """Kept since the table is; a store from before counts them anew."""
        return self.table("figures") if self._exists("figures") else figures.month_figures(self.stories)

    def _refigure(self, here, gone: DataFrame, changed: DataFrame, path: str) -> None:
        """The figures of the months ``here`` after their stories ``gone`` made way for ``changed``."""
        lost = self.stories.where(here).join(gone, ["shard", "story_id"], "left_semi")
        self._write(figures.added(self.figures.where(here), figures.month_figures(lost, -1), figures.month_figures(changed)),
                    "figures", path)

    def _columns(self, name: str) -> list[str]:
        return self.spark.createDataFrame([], SCHEMAS[name]).columns

    def _write(self, df: DataFrame, name: str, path: str) -> DataFrame:
        """Rows of a month lie together and in date order inside a file. Returns the rows as they
        are written first, plain: dealing them by range reads them twice."""
        order = {"scrapes": ["shard", "date", "scrape_id"], "stories": ["shard", "date"],
                 "links": ["shard", "story_id", "scrape_id"], "figures": figures.KEY}[name]
        df = df.select(*self._columns(name))
        df.write.mode("overwrite").parquet(f"{path}-plain")
        rows = self.spark.read.schema(df.schema).parquet(f"{path}-plain")
        (rows.repartitionByRange(*order)
         .sortWithinPartitions(*order)
         .write.mode("overwrite").partitionBy("shard").parquet(path))
        return rows

    def _stage(self, job: str):
        def stage(df: DataFrame, name: str) -> DataFrame:
            path = f"{self.root}/_staging/{job}/{name}"
            df.write.mode("overwrite").parquet(path)
            return self.spark.read.parquet(path)
        return stage

    # -- commit -----------------------------------------------------------------------
    def _commit(self, job: str, touched: dict[str, Iterable[int | None]]) -> None:
        staged = {name: self._staged_months(job, name) for name in touched}
        rows = [(name, shard, shard in staged[name]) for name, shards in touched.items() for shard in shards]
        note = self.spark.createDataFrame(rows, "name STRING, shard INT, staged BOOLEAN").withColumn(
            "job", F.lit(job))
        note.coalesce(1).write.mode("overwrite").json(f"{self.root}/_commit")
        self._apply()

    def _staged_months(self, job: str, name: str) -> set[int | None]:
        """The months a job has staged rows of; every one has a folder with files."""
        path, fs = self._path("_staging", job, name)
        found = [s.getPath().getName().partition("shard=")[2] for s in fs.listStatus(path) if s.isDirectory()]
        return {None if x == _NULL else int(x) for x in found if x}

    def _apply(self) -> None:
        note = self.spark.read.schema("name STRING, shard INT, staged BOOLEAN, job STRING").json(
            f"{self.root}/_commit").collect()
        for r in note:
            month = f"shard={_NULL if r.shard is None else r.shard}"
            source = ("_staging", r.job, r.name, month)
            if self._exists(*source):
                self._delete(r.name, month)
                self._move(source, (r.name, month))
            elif not r.staged:  # else an earlier try has moved it
                self._delete(r.name, month)
        self._delete("_commit")
        self._delete("_staging")

    def _move(self, source: tuple[str, ...], target: tuple[str, ...]) -> None:
        (old, fs), (new, _) = self._path(*source), self._path(*target)
        fs.mkdirs(new.getParent())
        if not fs.rename(old, new):
            raise OSError(f"cannot move {old} to {new}")

    def _recover(self) -> None:
        if self._exists("_commit", "_SUCCESS"):
            self._apply()

    # -- jobs -------------------------------------------------------------------------
    def load(self, scrapes: DataFrame) -> None:
        """Bulk build from nothing: cluster everything, no lookup."""
        job = "load"
        folder = f"{self.root}/_staging/{job}"
        rows = scrapes if "seq" in scrapes.columns else scrapes.withColumn("seq", F.lit(0))
        # An id is kept once, whatever months it was seen in; both other tables follow from that.
        written = self._write(upsert.unique_scrapes(rows.select(*self._columns("scrapes"), "seq"), self.cfg.merge_policy),
                              "scrapes", f"{folder}/scrapes")
        built = self._write(st.build_stories(written, self.cfg), "stories", f"{folder}/stories")
        self._write(st.story_links(written, self.cfg), "links", f"{folder}/links")
        self._write(figures.month_figures(built), "figures", f"{folder}/figures")
        self._commit(job, {name: self._staged_months(job, name) for name in SCHEMAS})

    def _months(self, df: DataFrame) -> list[int]:
        """Distinct months; at most 65 536 of them."""
        return sorted(r.shard for r in df.select("shard").distinct().collect())

    def ingest(self, batch: DataFrame, job: str = "ingest") -> DataFrame:
        """Upsert a batch of scrapes and merge it into the stories; returns the summary."""
        stage, folder = self._stage(job), f"{self.root}/_staging/{job}"
        if "seq" not in batch.columns:
            batch = batch.withColumn("seq", F.lit(0).cast("bigint"))
        batch = stage(batch.select(*self._columns("scrapes"), "seq"), "batch")
        months = self._months(batch)
        if not months:
            return counts.insert_summary(self.spark.createDataFrame([], "result STRING"))
        old_raw = self.scrapes.where(F.col("shard").isin(months))
        self._write(upsert.upsert_scrapes(old_raw, batch, self.cfg.merge_policy), "scrapes",
                    f"{folder}/scrapes")
        # A batch month can meet stories of its own month and of the month before.
        around = F.col("shard").isin(sorted({m for s in months for m in (s, s - 1)}))
        near = self.stories.where(around)
        out = merge.merge_batch(batch, near, self.links.where(around), self.scrapes, self.cfg, stage)
        changed, gone = stage(out.changed, "changed"), stage(out.gone, "gone")
        new_links = stage(out.links, "new_links")
        left = near.join(gone, ["shard", "story_id"], "left_semi")
        touched = sorted({*self._months(changed), *self._months(left)})
        here = F.col("shard").isin(touched)
        self._write(upsert.replace_rows(self.stories.where(here), gone, changed, ["shard", "story_id"]),
                    "stories", f"{folder}/stories")
        self._write(upsert.replace_rows(self.links.where(here), gone, new_links, ["shard", "story_id"]),
                    "links", f"{folder}/links")
        self._refigure(here, gone, changed, f"{folder}/figures")
        summary = counts.insert_summary(out.results).collect()
        self._commit(job, {"scrapes": months, "stories": touched, "links": touched, "figures": touched})
        return self.spark.createDataFrame(
            summary, "merged BIGINT, existing BIGINT, new BIGINT, not_found BIGINT")

    def reindex(self, wanted: DataFrame, job: str = "reindex") -> DataFrame:
        """Recompute the given stories with the current configuration."""
        stage, folder = self._stage(job), f"{self.root}/_staging/{job}"
        # A story id holds its month.
        wanted = stage(wanted.select("story_id").distinct().withColumn(
            "shard", ids.decode_story_id(F.col("story_id"))["shard"]), "wanted")
        theirs = F.col("shard").isin(self._months(wanted.where("shard IS NOT NULL")))
        out = merge.reindex(wanted, self.stories.where(theirs), self.links.where(theirs), self.scrapes,
                            self.cfg, stage)
        changed, gone = stage(out.changed, "changed"), stage(out.gone, "gone")
        new_links = stage(out.links, "new_links")
        left = self.stories.where(theirs).join(gone, ["shard", "story_id"], "left_semi")
        touched = sorted({*self._months(changed), *self._months(left)})
        here = F.col("shard").isin(touched)
        self._write(upsert.replace_rows(self.stories.where(here), gone, changed, ["shard", "story_id"]),
                    "stories", f"{folder}/stories")
        self._write(upsert.replace_rows(self.links.where(here), gone, new_links, ["shard", "story_id"]),
                    "links", f"{folder}/links")
        self._refigure(here, gone, changed, f"{folder}/figures")
        summary = counts.insert_summary(out.results).collect()
        self._commit(job, {"stories": touched, "links": touched, "figures": touched})
        return self.spark.createDataFrame(
            summary, "merged BIGINT, existing BIGINT, new BIGINT, not_found BIGINT")

    def note_warnings(self, warnings: DataFrame, batch_id: int) -> None:
        """Keep the warnings (payload, source, message) of one batch."""
        (warnings.withColumn("batch", F.lit(batch_id)).write.mode("overwrite")
         .option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(f"{self.root}/warnings"))

    @property
    def warnings(self) -> DataFrame:
        schema = "payload BIGINT, source STRING, message STRING, batch BIGINT"
        if not self._exists("warnings"):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(f"{self.root}/warnings")

    def front_page(self, pinned_url: str | None = None) -> DataFrame:
        return front_page.front_page(self.stories, self.cfg, pinned_url, stored=True)

    def search(self, kind: str, query: str, alt: str | None = None, now=None) -> DataFrame:
        """One classified search; reads the months that hold its hits."""
        now = counts.newest(self.stories).scalar() if now is None else now
        return search.run(self.stories, kind, query, alt, now, self.cfg, self.figures)

    def refresh_hot_set(self, pinned_url: str | None = None) -> DataFrame:
        """Write the hot set, a table bounded by its configured size, as a new version, and then
        point to it. Readers of the version before are not disturbed; older ones go."""
        before, version = self._hot_version(), uuid.uuid4().hex
        self.front_page(pinned_url).coalesce(1).write.parquet(f"{self.root}/hot_set/{version}")
        self._point("hot_set/current", version)
        path, fs = self._path("hot_set")
        for entry in fs.listStatus(path):
            if entry.isDirectory() and entry.getPath().getName() not in (before, version):
                fs.delete(entry.getPath(), True)
        return self.hot_set

    def _hot_version(self) -> str | None:
        if not self._exists("hot_set", "current"):
            return None
        return self.spark.read.text(f"{self.root}/hot_set/current").first()[0]

    @property
    def hot_set(self) -> DataFrame:
        """The newest complete version of the hot set; before the first, the front page itself."""
        version = self._hot_version()
        return self.front_page() if version is None else self.spark.read.parquet(f"{self.root}/hot_set/{version}")

    def _point(self, name: str, value: str) -> None:
        """Replace a small file at once: written beside it, then renamed over it."""
        aside, fs = self._path(f"{name}-{uuid.uuid4().hex}")
        out = fs.create(aside, True)
        out.write(value.encode())
        out.close()
        jvm, gateway = self.spark._jvm, self.spark.sparkContext._gateway
        rename = getattr(jvm.org.apache.hadoop.fs, "Options$Rename")
        how = gateway.new_array(rename, 1)
        how[0] = rename.OVERWRITE
        place = self._path(name)[0]
        uri = fs.makeQualified(place).toUri()
        jvm.org.apache.hadoop.fs.FileContext.getFileContext(uri, self.spark._jsc.hadoopConfiguration()).rename(
            fs.makeQualified(aside), fs.makeQualified(place), how)

    def backup(self, folder: str) -> DataFrame:
        """Back up the months whose statistics changed; oldest first in the result."""
        manifest = None
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/manifest")
        fs = path.getFileSystem(self.spark._jsc.hadoopConfiguration())
        columns = backup.MANIFEST
        if fs.exists(path):
            # One row per month: read now, because the folder is replaced below.
            manifest = self.spark.createDataFrame(
                self.spark.read.schema(columns).json(f"{folder}/manifest").collect(), columns)
        result = self.spark.createDataFrame(
            backup.backup(self.scrapes, manifest, f"{folder}/data").collect(),
            f"{columns}, result STRING")
        result.where("result <> 'empty'").drop("result").coalesce(1).write.mode("overwrite").json(f"{folder}/manifest")
        return result.orderBy("shard")

    def validate(self) -> DataFrame:
        return quality.validate(self.stories, self.links, self.scrapes)

    def broken(self) -> DataFrame:
        """(table, file, id, message): files that cannot be read, and rows that cannot be used."""
        out = self.spark.createDataFrame([], "table STRING, file STRING, id STRING, message STRING")
        for name in SCHEMAS:
            if not self._exists(name):
                continue
            path = f"{self.root}/{name}"
            lost = stored.unreadable_files(self.spark, path, SCHEMAS[name]).select(
                F.lit(name).alias("table"), "file", F.lit(None).cast("string").alias("id"), "message")
            out = out.unionByName(lost)
            key = {"scrapes": "scrape_id", "stories": "story_id"}.get(name)
            if key:
                rows = self.spark.read.schema(SCHEMAS[name]).option("ignoreCorruptFiles", "true").parquet(path)
                out = out.unionByName(stored.scan_range(rows, key=key).errors.select(F.lit(name).alias("table"), "file", "id", "message"))
        return out
