"""The stored archive: messages, vectors, postings and attachments as Parquet."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from epistle.operators import fulltext, maintenance
from epistle.operators import vectors as vector_ops
from epistle.schema import MESSAGES, VECTORS, validate_schema, with_defaults


class Archive:
    """An archive below one folder. Messages are partitioned by year, so that date filters prune, and sorted by
    sender within files, so that sender filters skip row groups."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _read(self, name: str, schema=None) -> DataFrame:
        reader = self.spark.read if schema is None else self.spark.read.schema(schema)
        return reader.parquet(f"{self.path}/{name}")

    def exists(self, name: str) -> bool:
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(path)

    def messages(self) -> DataFrame:
        return with_defaults(self._read("messages").drop("year"))

    def vectors(self) -> DataFrame:
        return self._read("vectors", VECTORS)

    def append(self, messages: DataFrame) -> None:
        """Add messages; those whose message_id is stored are left out. Derived tables that exist get the new messages' rows."""
        rows = maintenance.new_messages(validate_schema(messages, MESSAGES), self.messages() if self.exists("messages") else None)
        self._laid_out(rows).write.mode("append").partitionBy("year").parquet(f"{self.path}/messages")
        self.sync_index()

    def sync_index(self) -> dict:
        """Add what stored messages lack in the derived tables that exist: postings, lengths, vectors and attachments. Says how
        many messages each table lacked. Running it again adds nothing, so a load that failed between two tables is
        made good by the next."""
        report = {}
        for name in ("lengths", "vectors", "attachments"):
            if not self.exists(name):
                continue
            rows = self.messages()
            if name == "attachments":
                each = rows.select("id", "ts_raw", F.explode("attachments").alias("a")).select("id", "ts_raw", "a.*")
                new = maintenance.attachment_registry(each).join(self._read(name).select("sha256"), "sha256", "left_anti")
            else:
                new = rows.join(self._read(name).select("id"), "id", "left_anti")
                new = new.where("embedding IS NOT NULL") if name == "vectors" else new
            report[name] = new.count()
            if not report[name]:
                continue
            if name == "lengths":  # postings first: a message counts as indexed once its length is stored
                index = fulltext.postings(new)
                index = index.join(self._read("postings").select("id").distinct().join(new.select("id"), "id"), "id", "left_anti")
                index.select("term", "id", "col", "positions").repartitionByRange("term").sortWithinPartitions("term", "id").write.mode("append").parquet(f"{self.path}/postings")
                fulltext.document_lengths(new).write.mode("append").parquet(f"{self.path}/lengths")
            elif name == "vectors":
                vector_ops.vector_table(new).write.mode("append").parquet(f"{self.path}/vectors")
            else:
                new.write.mode("append").parquet(f"{self.path}/attachments")
        return report

    def store_attachments(self, contents: DataFrame) -> None:
        """Add attachments' bytes (sha256, content), each content once."""
        new = contents.dropDuplicates(["sha256"])
        if self.exists("attachment_data"):
            new = new.join(self._read("attachment_data").select("sha256"), "sha256", "left_anti")
        new.write.mode("append").parquet(f"{self.path}/attachment_data")

    def attachment(self, sha256: str) -> bytes | None:
        """The bytes of a stored attachment."""
        found = self._read("attachment_data").where(F.col("sha256") == sha256).select("content").first() if self.exists("attachment_data") else None
        return None if found is None else bytes(found.content)

    def delete_orphans(self) -> int:
        """Delete stored attachments that no message has; returns how many there were."""
        if not self.exists("attachment_data"):
            return 0
        used = self.messages().select(F.explode("attachments.sha256").alias("sha256")).distinct()
        data = self._read("attachment_data")
        gone = data.join(used, "sha256", "left_anti").count()
        if gone:
            self._replace("attachment_data", data.join(used, "sha256", "left_semi"))
        return gone

    def search(self, query: str) -> DataFrame:
        """id and rank of the messages that match: from the stored index where there is one, else from the texts."""
        if self.exists("postings") and self.exists("lengths"):
            return fulltext.search_index(self._read("postings"), self._read("lengths"), query)
        return fulltext.search(self.messages(), query)

    @staticmethod
    def _laid_out(rows: DataFrame) -> DataFrame:
        return rows.withColumn("year", F.coalesce(F.substring("ts_raw", 1, 4), F.lit("none"))).sortWithinPartitions("from_address")

    def _replace(self, name: str, df: DataFrame, partition: tuple[str, ...] = ()) -> None:
        """Write beside the old table, then swap: the old one is moved aside first, so that a failure leaves one or the other."""
        df.write.mode("overwrite").partitionBy(*partition).parquet(f"{self.path}/{name}.next")
        hadoop = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        new, old, aside = hadoop(f"{self.path}/{name}.next"), hadoop(f"{self.path}/{name}"), hadoop(f"{self.path}/{name}.old")
        fs = new.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        fs.delete(aside, True)
        if fs.exists(old):
            fs.rename(old, aside)
        fs.rename(new, old)
        fs.delete(aside, True)

    def replace_messages(self, messages: DataFrame) -> None:
        """Put messages in place of all that are stored, as a backfill does."""
        self._replace("messages", self._laid_out(messages), ("year",))

    def rebuild_index(self, name: str = "all") -> dict:
        """Rebuild derived tables; returns the report on vectors. A vector of another length fails the rebuild
        and leaves the old index."""
        rows = self.messages()
        if name in ("all", "postings"):
            index = fulltext.postings(rows)
            # one range of terms a file, so that a search reads the files of its terms only
            self._replace("postings", index.repartitionByRange("term").sortWithinPartitions("term", "id"))
            self._replace("lengths", fulltext.document_lengths(rows))
        if name in ("all", "vectors"):
            dims = rows.where("embedding IS NOT NULL").agg(F.max(F.size("embedding"))).first()[0]
            made = rows.withColumn("embedding", vector_ops.check_dimension(F.col("embedding"), dims or 0))
            self._replace("vectors", vector_ops.vector_table(made))
        if name in ("all", "attachments"):
            each = rows.select("id", "ts_raw", F.explode("attachments").alias("a")).select("id", "ts_raw", "a.*")
            self._replace("attachments", maintenance.attachment_registry(each))
        return maintenance.index_report(rows, self.vectors()).first().asDict() if self.exists("vectors") else {}

    def fill_embeddings(self, text, dims: int, mode: str = "missing", encoder=vector_ops.encode_text) -> dict:
        """Embed messages without a vector (missing) or every message (all), then rebuild the index."""
        if mode not in ("missing", "all"):
            raise ValueError("mode is missing or all")
        rows = self.messages()
        if mode == "all":
            rows = rows.withColumn("embedding", F.lit(None).cast("array<float>"))
        self.replace_messages(vector_ops.embed(rows, text, dims, encoder))
        return self.rebuild_index("vectors")

    def search_terms(self, terms: list[str]) -> DataFrame:
        return fulltext.search_postings(self._read("postings"), self._read("lengths"), terms)
