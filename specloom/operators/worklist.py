"""Processing only new or changed records: a work-item ledger.

An item is one version of a record: (rec_table, rec_id, digest). The ledger is an append-only event log; the state of a record
is folded from its events, so that a repeated or broken run neither loses nor repeats a record:

* no event, or another digest done last (also if this one was done before that), or a null digest registered anew: ``pending``
* an open lease: ``leased``; a lease that ran out, or whose run ended without success: ``pending`` again
* a ``done`` event that carries the record's newest fencing token: ``done``; one that carries an older token comes from a
  stale writer (its lease ran out and the record was leased again) and is rejected

Tokens are drawn by creating a file that must not exist yet, so that no two runs ever hold the same one. Events and outputs are written under
paths that derive from batch and token only, so a retried write replaces its own files. ``compact`` folds the log to a few events a record.
"""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..runtime import cut

KEYS = ["rec_table", "rec_id"]
#: ``of`` is the token under which the version that an event is about was registered.
EVENTS = "rec_table string, rec_id string, digest string, event string, token bigint, of bigint, owner string, until timestamp_ntz, at timestamp_ntz, seq bigint"
COLUMNS = [c.split()[0] for c in EVENTS.split(", ")]
KINDS = ("new", "lease", "done", "release", "removed")


def digest(col: Column) -> Column:
    """The digest proper: no letter case, surrounding blanks or leading algorithm name; null for a null or blank hash."""
    bare = F.regexp_replace(F.lower(col), r"(?U)^[\s\p{Z}\p{Cc}\x{FEFF}\x{200B}]+|[\s\p{Z}\p{Cc}\x{FEFF}\x{200B}]+$", "")
    bare = F.regexp_replace(bare, r"(?U)^[a-z][a-z0-9_/-]*[\s\p{Z}]*[:=][\s\p{Z}]*", "")
    return F.when(bare != "", bare)


def last_reports(manifests: DataFrame) -> DataFrame:
    """One row per run: the status of its last report (ties: the greater status by name)."""
    return manifests.groupBy("run_id").agg(F.max(F.struct("reported_at", "status")).alias("r")).select("run_id", F.col("r.status").alias("status"))


def _event(rec_table: Column, rec_id: str, event: Column, token: int, at: str, digest: Column, seq: Column | None = None) -> list[Column]:
    """The columns of an event of the given tables. All their runs came before the snapshot that is registered now: token 0 against its 1."""
    values = {
        "rec_table": rec_table, "rec_id": F.col(rec_id), "digest": digest, "event": event, "token": F.lit(token), "of": F.lit(token), "owner": F.lit(None), "until": F.col(at), "at": F.col(at), "seq": F.lit(0) if seq is None else seq,
    }
    return [values[c].cast(kind).alias(c) for c, kind in (x.split() for x in EVENTS.split(", "))]


def current_versions(rows: DataFrame, rec_table: str, id_col: str, hash_col: str, at_col: str) -> DataFrame:
    """Events ``new``: every delivered version of the records of one table, unreduced (the fold takes the latest)."""
    return rows.select(*_event(F.lit(rec_table), id_col, F.lit("new"), 1, at_col, digest(F.col(hash_col))))


def done_versions(ledger: DataFrame, manifests: DataFrame) -> DataFrame:
    """Events ``done``: what runs whose last report is a success have handled; ``lease``, run out when it was given: what other runs took.

    The order is that of processed_at, then ledger_id, not that of run_id: a run with a lower number may have handled a record later.
    The runs are one row each; whether that side is broadcast is left to the planner, which knows its size."""
    event = F.when(F.col("status") == "success", "done").otherwise("lease")
    rows = ledger.join(last_reports(manifests), "run_id", "left")
    return rows.select(*_event(F.col("rec_table"), "rec_id", event, 0, "processed_at", digest(F.col("seen_hash")), F.col("ledger_id")))


def removed_records(removals: DataFrame, rec_table: str, id_col: str, at_col: str) -> DataFrame:
    return removals.select(*_event(F.lit(rec_table), id_col, F.lit("removed"), 0, at_col, F.lit(None).cast("string")))


def _last(events: DataFrame, *also: Column) -> DataFrame:
    """Per record the last event of each kind, as structs in the order that decides; combined before its one shuffle."""
    last = lambda kind, *cols: F.max(F.when(F.col("event") == kind, F.struct(*cols))).alias(kind)
    return (
        events.filter(F.col("rec_id").isNotNull())
        .groupBy(*KEYS)
        .agg(
            last("new", "token", "at", "owner", "digest"),
            last("done", "token", "at", "seq", "digest", "of"),
            last("lease", "token", "at", "seq", "digest", "owner", "until", "of"),
            last("release", "token"),
            last("removed", "at"),
            *also,
        )
    )


def fold(events: DataFrame, now=None) -> DataFrame:
    """(rec_table, rec_id, digest, at, of, done_digest, state, token, owner): one row per record that was registered, done or removed, for the version
    registered last, with the state ``pending``, ``leased``, ``done``, ``removed`` or ``unknown``. ``now`` decides which leases have run out; without it, all have.

    One shuffle: each event kind is a conditional max, combined before the shuffle, so a key with a third of all rows travels as one row
    a task. Rows with a null id are no records. A null digest differs from everything, also from null: it is a version of its own each time it is
    registered, and only a lease of that version can have handled it. Ties: greater sequence, then digest."""
    g = _last(events).filter("new is not null or done is not null or removed is not null")
    of_current = lambda e: F.col(e).isNotNull() & F.col(f"{e}.digest").eqNullSafe(F.col("new.digest")) & (F.col("new.digest").isNotNull() | (F.col(f"{e}.of") >= F.col("new.token")))
    held = of_current("lease") & (F.coalesce("release.token", F.lit(-1)) < F.col("lease.token"))
    state = (
        F.when(F.col("new").isNull(), "unknown")
        .when(F.col("removed.at") > F.col("new.at"), "removed")
        .when(of_current("done") & ~(held & (F.col("lease.token") > F.col("done.token"))), "done")
        .when(held & (F.col("lease.until") > F.lit(now).cast("timestamp_ntz")), "leased")
        .otherwise("pending")
    )
    return g.select(*KEYS, F.col("new.digest").alias("digest"), F.col("new.at").alias("at"), F.col("new.token").alias("of"), F.col("done.digest").alias("done_digest"), F.col("done.token").alias("done_token"), state.alias("state"), F.col("lease.token").alias("token"), F.col("lease.owner").alias("owner"))


class StaleToken(RuntimeError):
    """A writer whose lease ran out and whose records were all leased anew."""


class WorkLedger:
    """The ledger as files below ``path`` (a folder all executors share), after the events of ``given``, a read-only log of the same columns, if there is one.

    The file system must create a file only where there is none (HDFS and local disks do); nothing else is asked of it."""

    def __init__(self, spark: SparkSession, path: str, given: DataFrame | None = None):
        self.spark, self.path, self.given = spark, path.rstrip("/"), given
        self._hadoop = spark._jvm.org.apache.hadoop.fs
        self._fs = self._hadoop.Path(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    # Files ---------------------------------------------------------------------------------------------------------------

    def _at(self, *parts):
        return self._hadoop.Path("/".join([self.path, *map(str, parts)]))

    def _names(self, *parts) -> list[str]:
        at = self._at(*parts)
        return [f.getPath().getName() for f in self._fs.listStatus(at)] if self._fs.exists(at) else []

    def _create(self, *parts) -> bool:
        """Create an empty file; False if it is there already. Of several who try at once one only gets True."""
        at = self._at(*parts)
        if self._fs.getUri().getScheme() == "file":  # Hadoop's local file system looks first and creates then; the operating system does both at once
            name = self._fs.makeQualified(at).toUri().getPath()
            os.makedirs(os.path.dirname(name), exist_ok=True)
            try:
                os.close(os.open(name, os.O_CREAT | os.O_EXCL))
                return True
            except FileExistsError:
                return False
        try:
            self._fs.create(at, False).close()
            return True
        except Exception:
            if self._fs.exists(at):
                return False
            raise

    def _draw(self) -> int:
        """A fencing token greater than all drawn before. Tokens 0 and 1 are those of the given log."""
        token = max((int(n) for n in self._names("tokens") if n.isdigit()), default=1) + 1
        while not self._create("tokens", token):
            token += 1
        return token

    def _folders(self) -> list[str]:
        """Folders of the log that count: the newest finished snapshot, and what it does not replace."""
        done = [n for n in self._names("snapshot") if "_SUCCESS" in self._names("snapshot", n)]
        newest = max(done, key=int, default=None)
        old = set(self._names("replaced", newest)) if newest else set()
        return ([f"snapshot/{newest}"] if newest else []) + [f"{kind}/{n}" for kind in KINDS for n in self._names(kind) if f"{kind}.{n}" not in old and "_SUCCESS" in self._names(kind, n)]

    def _events(self) -> DataFrame:
        folders = [f"{self.path}/{f}" for f in self._folders()]
        own = self.spark.read.schema(EVENTS).parquet(*folders) if folders else self.spark.createDataFrame([], EVENTS)
        return own if self.given is None else self.given.select(*COLUMNS).unionByName(own)

    def _write(self, df: DataFrame, *parts) -> None:
        df.select(*COLUMNS).write.mode("overwrite").parquet("/".join([self.path, *map(str, parts)]))

    def _lease(self, token: int) -> DataFrame:
        return self.spark.read.schema(EVENTS).parquet(f"{self.path}/lease/{token}")

    # The log -------------------------------------------------------------------------------------------------------------

    def state(self, now) -> DataFrame:
        """(rec_table, rec_id, digest, state, token, owner): folded events. ``now`` decides which leases have run out."""
        return fold(self._events(), now).select(*KEYS, "digest", "state", "token", "owner")

    def enqueue(self, items: DataFrame, batch: str, now) -> None:
        """Register items (rec_table, rec_id, digest), a record's present version each (of several, the greatest digest).

        A version equal to the one registered last changes nothing, whatever came before that; a null digest equals none. The same batch written again
        replaces itself and keeps its place in the log (the token it drew first), so that it re-opens nothing."""
        if not self._names("batches", batch):
            self._create("batches", batch, self._draw())
        token = min(map(int, self._names("batches", batch)))
        before = self._events().filter((F.col("event") == "new") & (F.col("token") < token))
        known = before.groupBy(*KEYS).agg(F.max(F.struct("token", "at", "owner", "digest")).alias("k")).select(*KEYS, F.col("k.digest").alias("digest"))
        fresh = cut(items.filter(F.col("rec_id").isNotNull()).groupBy(*KEYS).agg(F.max("digest").alias("digest")).join(known, [*KEYS, "digest"], "left_anti"))
        self._write(self._rows(fresh, "new", token, F.lit(token), batch, None, now), "new", batch)

    def _rows(self, items: DataFrame, event: str, token: int, of: Column, owner, until, now) -> DataFrame:
        time = lambda x: F.lit(x).cast("timestamp_ntz")
        return items.select(*KEYS, "digest", F.lit(event).alias("event"), F.lit(token).cast("bigint").alias("token"), of.cast("bigint").alias("of"), F.lit(owner).cast("string").alias("owner"), time(until).alias("until"), time(now).alias("at"), F.lit(0).cast("bigint").alias("seq"))

    def lease(self, owner: str, until, now, limit: int | None = None) -> int:
        """Lease pending items until ``until``; gives the fencing token, greater than all before. Of two runs that lease the same item at once the greater token holds it."""
        token = self._draw()
        items = fold(self._events(), now).filter("state = 'pending'")
        if limit is not None:
            items = items.orderBy(*KEYS).limit(limit)
        self._write(self._rows(items, "lease", token, F.col("of"), owner, until, now), "lease", token)
        return token

    def leased(self, token: int) -> DataFrame:
        """(rec_table, rec_id, digest) as leased under a token."""
        return self._lease(token).select(*KEYS, "digest")

    def _mine(self, token: int) -> DataFrame:
        """Keys whose newest lease carries the token, or for which a ``done`` of it was accepted already."""
        accepted = F.max((F.col("event") == "done") & (F.col("token") == token)).alias("accepted")
        return _last(self._events(), accepted).filter((F.col("lease.token") == token) | F.col("accepted")).select(*KEYS)

    def publish(self, token: int, rows: DataFrame, name: str) -> str:
        """Write the results (rec_table, rec_id, ...) of a lease under a path made of name and token; gives the path. A retry replaces it.

        Refused with ``StaleToken`` where no record of the lease is the writer's any more. Results count (``published``) once their records are completed."""
        if self._mine(token).join(self._lease(token), KEYS, "left_semi").isEmpty():
            raise StaleToken(str(token))
        path = f"{self.path}/out/{name}/{token}"
        rows.withColumn("token", F.lit(token).cast("bigint")).write.mode("overwrite").parquet(path)
        return path

    def published(self, name: str) -> DataFrame | None:
        """The results of completed records, each as written under the token that completed it; what broken and stale runs wrote is left out. None before any."""
        paths = [f"{self.path}/out/{name}/{n}" for n in self._names("out", name) if "_SUCCESS" in self._names("out", name, n)]
        if not paths:
            return None
        done = fold(self._events()).select(*KEYS, F.col("done_token").alias("token"))
        return self.spark.read.parquet(*paths).join(done, [*KEYS, "token"], "left_semi").drop("token")

    def complete(self, token: int, now) -> int:
        """Mark the items of a lease done; gives how many were accepted. Records leased anew since then keep their newer token: this writer is stale for them,
        and no ``done`` is written. A retry keeps what was accepted before."""
        done = cut(self._lease(token).join(self._mine(token), KEYS, "left_semi"))
        self._write(self._rows(done, "done", token, F.col("of"), None, None, now), "done", token)
        return done.count()

    def fail(self, token: int, now) -> None:
        """A run that broke gives its items back at once."""
        self._write(self._rows(self._lease(token), "release", token, F.col("of"), None, None, now), "release", token)

    def compact(self) -> int:
        """Fold the log to the last event of each kind of each record, written as a snapshot under a token of its own, which is given. What it replaces is no longer read.

        Readers take a snapshot once it is whole; one that broke off is never read. The folders it replaces are noted before it is written."""
        number = self._draw()
        newest = [f for f in self._folders() if f.startswith("snapshot/")]
        for f in self._folders():
            self._create("replaced", number, f.replace("/", "."))
        if newest:
            for n in self._names("replaced", newest[0].split("/")[1]):
                self._create("replaced", number, n)
        kept = self._names("replaced", number)
        folders = newest + [f for f in self._folders() if f.replace("/", ".") in kept and f not in newest]
        log = self.spark.read.schema(EVENTS).parquet(*[f"{self.path}/{f}" for f in folders]) if folders else self.spark.createDataFrame([], EVENTS)
        kinds = dict(x.split() for x in EVENTS.split(", "))
        last = _last(log)
        has = {k: last.schema[k].dataType.names for k in KINDS}
        one = lambda k: F.struct(F.lit(k).alias("event"), *[(F.col(f"{k}.{c}") if c in has[k] else F.lit(None)).cast(kinds[c]).alias(c) for c in COLUMNS if c not in (*KEYS, "event")])
        rows = last.select(*KEYS, F.explode(F.filter(F.array(*[F.when(F.col(k).isNotNull(), one(k)) for k in KINDS]), lambda e: e.isNotNull())).alias("e")).select(*KEYS, "e.*")
        self._write(rows, "snapshot", number)
        return number
