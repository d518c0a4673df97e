"""The extension points with small functions, which SQL can follow."""

import pyarrow as pa
import pyarrow.compute as pc

from millrace.catalog.registry import query
from millrace.operators import custom


def _net(batches):
    """Price after discount, batch by batch."""
    for b in batches:
        net = pc.multiply(b.column("l_extendedprice"), pc.subtract(1.0, b.column("l_discount")))
        yield pa.RecordBatch.from_arrays([b.column("l_orderkey"), b.column("l_linenumber"), net], ["l_orderkey", "l_linenumber", "net"])


def _since_error(key, batches):
    """How many rows ago the user's last error was; state goes from batch to batch."""
    since = None
    for b in batches:
        out = []
        for kind in b.column("event_type").to_pylist():
            since = 0 if kind == "error" else None if since is None else since + 1
            out.append(since)
        yield pa.RecordBatch.from_arrays([b.column("event_id"), b.column("user_id"), pa.array(out, pa.int64())], ["event_id", "user_id", "since"])


class _Words:
    """A row for each word of a name."""

    def eval(self, row):
        for i, word in enumerate(row["p_name"].split(" ")):
            yield row["p_partkey"], i + 1, word


class _Runs:
    """A row for each run of equal event types of a user."""

    def __init__(self):
        self.run = None

    def eval(self, row):
        if self.run and self.run[1] == row["event_type"]:
            self.run[3] += 1
            return
        if self.run:
            yield tuple(self.run)
        self.run = [row["user_id"], row["event_type"], row["event_id"], 1]

    def terminate(self):
        if self.run:
            yield tuple(self.run)


query("runfunc", lambda t: custom.run_function(t.lineitem, _net, "l_orderkey long, l_linenumber int, net double", "l_orderkey,l_linenumber,l_extendedprice,l_discount"),
      "SELECT l_orderkey, l_linenumber, l_extendedprice * (1 - l_discount) AS net FROM lineitem", "net", 4)
query("keyblock", lambda t: custom.key_blocks(t.events, "user_id", "ts,event_id", _since_error, "event_id long, user_id long, since long", "event_id,event_type"),
      """SELECT event_id, user_id, n - max(CASE WHEN event_type = 'error' THEN n END) OVER (PARTITION BY user_id ORDER BY n) AS since
         FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events)""")
query("row_to_rows", lambda t: custom.table_function(t.part.select("p_partkey", "p_name"), _Words, "p_partkey long, place int, word string"),
      "SELECT p_partkey, CAST(unnest(range(1, len(string_split(p_name, ' ')) + 1)) AS INTEGER) AS place, unnest(string_split(p_name, ' ')) AS word FROM part")
query("keyed_table_function", lambda t: custom.table_function(t.events.select("user_id", "event_type", "event_id", "ts"), _Runs, "user_id long, event_type string, first_id long, n long", "user_id", "ts,event_id"),
      """SELECT user_id, event_type, min_by(event_id, n) AS first_id, count(*) AS n FROM (SELECT *, n - row_number() OVER (PARTITION BY user_id, event_type ORDER BY n) AS run
         FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events)) GROUP BY user_id, event_type, run""")
