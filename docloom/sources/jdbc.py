"""Question logs in a database: partitioned reads with pushed predicates and top-n, batch writes that may be run again, guarded transitions.

Rows move between Spark and the database in parallel; the driver sends only statements, each change in one transaction. The
SQL is standard (FETCH FIRST, no upsert clause), so that it runs on PostgreSQL and on Derby alike.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The longest error text that a failed row keeps, and seconds between purges at least.
ERROR_CHARS, PURGE_EVERY = 1000, 3600.0


@dataclass
class Database:
    """A JDBC address; `options` are the driver's (user, password)."""

    spark: SparkSession
    url: str
    driver: str
    options: dict = field(default_factory=dict)

    @contextmanager
    def transaction(self) -> Iterator:
        """A connection whose changes are kept together when the block ends, and none of them when it fails."""
        jvm = self.spark.sparkContext._jvm
        loader = jvm.java.lang.Thread.currentThread().getContextClassLoader()
        source = jvm.java.lang.Class.forName(self.driver, True, loader).newInstance()
        given = jvm.java.util.Properties()
        for k, v in self.options.items():
            given.setProperty(k, v)
        connection = source.connect(self.url, given)
        try:
            connection.setAutoCommit(False)
            yield connection
            connection.commit()
        except BaseException:
            connection.rollback()
            raise
        finally:
            connection.close()

    def execute(self, connection, sql: str, *values) -> int:
        """Rows that a statement changed."""
        statement = connection.prepareStatement(sql)
        try:
            for i, v in enumerate(values, 1):
                statement.setObject(i, v)
            return statement.executeUpdate()
        finally:
            statement.close()

    def one(self, sql: str) -> list:
        """The first row of a query, or an empty list."""
        with self.transaction() as c:
            found = c.createStatement().executeQuery(sql)
            return [found.getObject(i) for i in range(1, found.getMetaData().getColumnCount() + 1)] if found.next() else []

    def has(self, table: str) -> bool:
        with self.transaction() as c:
            return c.getMetaData().getTables(None, None, table.upper(), None).next() or c.getMetaData().getTables(None, None, table.lower(), None).next()

    def frame(self, what: str, **options) -> DataFrame:
        return self.spark.read.format("jdbc").options(url=self.url, driver=self.driver, dbtable=what, **self.options, **options).load()

    def scan(self, table: str, key: str = "id", rows_each: int = 1_000_000) -> DataFrame:
        """A table as parallel range reads over a whole-number key; filters and columns of later steps reach the database."""
        low, high = self.one(f"SELECT MIN({key}), MAX({key}) FROM {table}")
        if low is None or int(high) - int(low) < rows_each:
            return self.frame(table)
        parts = -(-(int(high) - int(low) + 1) // rows_each)
        return self.frame(table, partitionColumn=key, lowerBound=int(low), upperBound=int(high) + 1, numPartitions=parts)

    def newest(self, table: str, created: str, key: str, limit: int, since: str | None = None) -> DataFrame:
        """The newest rows, from a time (such as 2024-01-24 00:00:00) on; the database sorts and cuts off, so that no more than these rows travel."""
        where = "" if since is None else f" WHERE {created} >= TIMESTAMP('{since}')" if "derby" in self.driver else f" WHERE {created} >= TIMESTAMP '{since}'"
        return self.frame(f"(SELECT * FROM {table}{where} ORDER BY {created} DESC, {key} DESC FETCH FIRST {int(limit)} ROWS ONLY) newest").orderBy(F.desc(created), F.desc(key))

    def put(self, df: DataFrame, table: str, key: str, batch: int) -> bool:
        """The rows of a batch in place of those of the same key, or added: all of them or none, and once for each batch number. False if it was there already.

        Rows go to a table of their own in parallel; one transaction moves them over and notes the batch.
        """
        ledger, stage = f"{table}_batches", f"{table}_stage"
        if not self.has(ledger):
            with self.transaction() as c:
                self.execute(c, f"CREATE TABLE {ledger} (batch BIGINT NOT NULL PRIMARY KEY)")
        if self.one(f"SELECT batch FROM {ledger} WHERE batch = {int(batch)}"):
            return False
        writer = lambda frame, to, mode: frame.write.format("jdbc").options(url=self.url, driver=self.driver, dbtable=to, **self.options).mode(mode).save()
        if not self.has(table):
            writer(df.limit(0), table, "errorifexists")
        writer(df, stage, "overwrite")
        names = ", ".join(self.quoted(c) for c in df.columns)
        with self.transaction() as c:
            self.execute(c, f"INSERT INTO {ledger} VALUES ({int(batch)})")
            self.execute(c, f"DELETE FROM {table} WHERE {self.quoted(key)} IN (SELECT {self.quoted(key)} FROM {stage})")
            self.execute(c, f"INSERT INTO {table} ({names}) SELECT {names} FROM {stage}")
        return True

    def quoted(self, name: str) -> str:
        """As Spark's writer names columns."""
        return f'"{name}"'


@dataclass
class ChatLog:
    """Questions from pending to answered or failed, in a table of the database."""

    db: Database
    table: str = "chat_logs"
    months: int = 4
    purged: float = float("-inf")

    def create(self, legacy: str | None = None) -> int:
        """Makes the table where it is not there; an empty one gets the questions of a legacy table (session_id, message, created_at). Gives the number of rows copied."""
        if not self.db.has(self.table):
            with self.db.transaction() as c:
                self.db.execute(c, f"""CREATE TABLE {self.table} (id BIGINT GENERATED BY DEFAULT AS IDENTITY PRIMARY KEY, session_id VARCHAR(200), question VARCHAR(20000) NOT NULL, answer VARCHAR(20000), model_name VARCHAR(200), sources VARCHAR(10000) DEFAULT '[]' NOT NULL,
                    status VARCHAR(20) DEFAULT 'pending' NOT NULL CHECK (status IN ('pending', 'answered', 'failed', 'legacy')), error VARCHAR({ERROR_CHARS}), created_at TIMESTAMP DEFAULT CURRENT_TIMESTAMP NOT NULL, answered_at TIMESTAMP)""")
                self.db.execute(c, f"CREATE INDEX {self.table}_created ON {self.table}(created_at)")
        if legacy is None or not self.db.has(legacy) or self.db.one(f"SELECT id FROM {self.table} FETCH FIRST 1 ROWS ONLY"):
            return 0
        with self.db.transaction() as c:
            return self.db.execute(c, f"INSERT INTO {self.table} (session_id, question, status, created_at) SELECT session_id, message, 'legacy', created_at FROM {legacy}")

    def add(self, question: str, session: str | None, now: float = 0.0) -> int:
        """Stores a question and gives its id; old rows are purged first, at most once in an hour (`now` in seconds)."""
        if now - self.purged > PURGE_EVERY:
            self.purge()
            self.purged = now
        with self.db.transaction() as c:
            keys = self.db.spark.sparkContext._gateway.new_array(self.db.spark.sparkContext._jvm.java.lang.String, 1)
            keys[0] = "ID" if "derby" in self.db.driver else "id"
            statement = c.prepareStatement(f"INSERT INTO {self.table} (question, session_id) VALUES (?, ?)", keys)
            statement.setString(1, question.strip())
            statement.setString(2, session)
            statement.executeUpdate()
            made = statement.getGeneratedKeys()
            made.next()
            return int(made.getLong(1))

    def answered(self, ident: int, answer: str, model: str | None, sources: str = "[]") -> bool:
        """pending to answered; False for a row that is not pending."""
        with self.db.transaction() as c:
            return self.db.execute(c, f"UPDATE {self.table} SET answer = ?, model_name = ?, sources = ?, status = 'answered', answered_at = CURRENT_TIMESTAMP WHERE id = ? AND status = 'pending'", answer, model, sources, ident) == 1

    def failed(self, ident: int, error: str) -> bool:
        """pending to failed, with the first ERROR_CHARS characters of the error; False for a row that is not pending."""
        with self.db.transaction() as c:
            return self.db.execute(c, f"UPDATE {self.table} SET status = 'failed', error = ? WHERE id = ? AND status = 'pending'", error[:ERROR_CHARS], ident) == 1

    def settle(self, outcomes: DataFrame) -> int:
        """Many transitions at once, from rows (id, status, answer, error): pending rows alone change, of an id that stands twice the answered row counts. Gives the number of rows changed."""
        stage = f"{self.table}_outcomes"
        once = outcomes.where(F.col("status").isin("answered", "failed")).groupBy("id").agg(F.min_by(F.struct("status", "answer", "error"), F.struct("status", "answer", "error")).alias("o"))
        rows = once.select("id", "o.status", F.substring("o.answer", 1, 20000).alias("answer"), F.substring("o.error", 1, ERROR_CHARS).alias("error"))
        rows.write.format("jdbc").options(url=self.db.url, driver=self.db.driver, dbtable=stage, **self.db.options).mode("overwrite").save()
        q = self.db.quoted
        wide = {"status": 20, "answer": 20000, "error": ERROR_CHARS}
        of = lambda c: f"(SELECT CAST(s.{q(c)} AS VARCHAR({wide[c]})) FROM {stage} s WHERE s.{q('id')} = {self.table}.id)"
        with self.db.transaction() as c:
            return self.db.execute(c, f"UPDATE {self.table} SET status = {of('status')}, answer = {of('answer')}, error = {of('error')}, answered_at = CASE WHEN {of('status')} = 'answered' THEN CURRENT_TIMESTAMP END WHERE status = 'pending' AND id IN (SELECT {q('id')} FROM {stage})")

    def purge(self) -> int:
        """Deletes rows older than so many months; gives their number."""
        before = f"{{fn TIMESTAMPADD(SQL_TSI_MONTH, -{self.months}, CURRENT_TIMESTAMP)}}" if "derby" in self.db.driver else f"CURRENT_TIMESTAMP - INTERVAL '{self.months} months'"
        with self.db.transaction() as c:
            return self.db.execute(c, f"DELETE FROM {self.table} WHERE created_at < {before}")

    def recent(self, limit: int, since: str | None = None) -> DataFrame:
        return self.db.newest(self.table, "created_at", "id", limit, since)
