import json
import threading
from datetime import datetime, timezone
from http.server import BaseHTTPRequestHandler, HTTPServer
from urllib.parse import parse_qs, urlparse

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from ledgerloom import cli, ingest, schemas
from ledgerloom.functions import contract
from ledgerloom.operators import dedupe, incremental, summary
from ledgerloom.sources import files, rest
from ledgerloom.store import ParquetStore
from ledgerloom.streaming.adapter import ingest_new_files

HEAD = ",".join(schemas.FIELDS)
GOOD = ["TXN-1", "ACC-1001", "2024-01-05T10:00:00Z", "12.5", "USD", "debit", "Shop", "travel", "completed", "GB"]


def record(**changes):
    return [changes.get(n, v) for n, v in zip(schemas.FIELDS, GOOD)]


def write_csv(path, *records):
    path.write_text("\r\n".join([HEAD, *(",".join(r) for r in records)]) + "\r\n")
    return str(path)


@pytest.fixture
def store(spark, tmp_path):
    return ParquetStore(spark, str(tmp_path / "warehouse"), buckets=4)


def reasons(spark, *records):
    frame = spark.createDataFrame([tuple(r) for r in records], ", ".join(f"{n} string" for n in schemas.FIELDS))
    return [r[0] for r in frame.select(contract.reason(contract.errors(list(schemas.FIELDS), contract.country_codes(spark)))).collect()]


def test_contract_messages(spark):
    got = reasons(spark, GOOD, record(amount="0.0", transaction_type="Credit", country_code="EN"), record(transaction_date="2024-11-31T14:22:00Z", country_code="UK"),
                  record(merchant_name="   ", amount="-127.5"), record(amount="abc"), record(amount="1.005"), record(currency=None), record(account_id="ACC-1'\n"))
    assert got[0] is None
    assert got[1] == "amount: Decimal('0.0') is less than or equal to the minimum of 0; transaction_type: 'Credit' is not one of ['debit', 'credit']; country_code: invalid assigned ISO code EN"
    assert got[2] == "transaction_date: invalid calendar datetime 2024-11-31T14:22:00Z; country_code: invalid assigned ISO code UK"
    assert got[3] == "amount: Decimal('-127.5') is less than or equal to the minimum of 0; merchant_name: '   ' does not match '.*\\\\S.*'"
    assert got[4] == "amount: 'abc' is not of type 'number'" and got[5] == "amount: Decimal('1.005') is not a multiple of Decimal('0.01')"
    assert got[6].startswith("currency: None is not of type 'string'; currency: None is not one of") and got[7].startswith('account_id: "ACC-1\'\\n" does not match')


def test_missing_and_extra_columns(spark):
    frame = spark.createDataFrame([(*GOOD[1:], "x")], ", ".join(f"{n} string" for n in [*schemas.FIELDS[1:], "extra"]))
    assert frame.select(contract.errors(frame.columns, ["GB"])).first()[0] == ["record: 'transaction_id' is a required property", "record: Additional properties are not allowed ('extra' was unexpected)"]


def test_basic_then_incremental(spark, store, tmp_path):
    path = write_csv(tmp_path / "t.csv", GOOD, record(transaction_id="TXN-2"), record(transaction_id="TXN-3", transaction_date="2024-01-06 09:00:00+00:00", amount="10.005"), record(transaction_id="TXN-4", transaction_date="not-a-date"),
                     record(transaction_id="TXN-5", amount="1", transaction_date="2024-01-06T11:00:00Z"))
    s = ingest.Settings(source_file=path)
    log = ingest.run_ingest(spark, store, s)
    assert [log[k] for k in ("input_records", "valid_records", "quarantine_records", "duplicate_records")] == [5, 3, 2, 1]
    assert store.read("transactions").where("is_duplicate").first().transaction_id == "TXN-2"
    assert str(store.read("quarantine").where("transaction_id = 'TXN-3'").first().amount) == "10.01"
    again = ingest.run_ingest(spark, store, s, use_mark=True)
    assert again["input_records"] == 0 and again["watermark_value"] is None  # undatable, but known
    s.lookback_hours = 2
    assert ingest.run_ingest(spark, store, s, use_mark=True)["input_records"] == 2  # from 09:00 on, and at it
    assert store.read("transactions").count() == 3 and store.read("ingestion_run_log").count() == 3
    assert ingest.run_summary(spark, store, s) | {"watermark_value": None} == {"mode": "full refresh", "rows_computed": 2, "watermark_value": None}
    before = {(r.account_id, r.transaction_date): r.total_debit_amount for r in store.read("daily_account_summary").collect()}
    late = write_csv(tmp_path / "late.csv", record(transaction_id="TXN-9", transaction_date="2024-01-06T23:00:00Z", amount="5"), record(transaction_id="TXN-9", transaction_date="2024-01-06T23:30:00Z", amount="6"))
    ingest.run_ingest(spark, store, ingest.Settings(source_file=late))
    assert ingest.run_summary(spark, store, s)["mode"] == "incremental merge"
    after = {(r.account_id, r.transaction_date): r.total_debit_amount for r in store.read("daily_account_summary").collect()}
    changed = {k for k in after if before.get(k) != after[k]}
    assert [str(k[1]) for k in changed] == ["2024-01-06"] and float(after[changed.pop()]) == 7.0  # a repeated id: its last row


def test_top_category_ties_and_no_debits(spark):
    rows = [("a", "2024-01-01", 5, "debit", "m", "y", "USD"), ("a", "2024-01-01", 5, "debit", "n", "x", "EUR"), ("b", "2024-01-01", 5, "credit", "m", "y", "USD")]
    frame = spark.createDataFrame(rows, "account_id string, d string, v int, transaction_type string, merchant_name string, merchant_category string, currency string").selectExpr("*", "cast(d as timestamp) transaction_date", "cast(v as decimal(18,2)) amount", "cast(d as timestamp) ingestion_timestamp")
    got = {r.account_id: (r.top_category, r.currencies, r.distinct_merchants) for r in summary.daily_summary(frame).collect()}
    assert got == {"a": ("x", "EUR,USD", 2), "b": (None, "USD", 1)}


@settings(max_examples=8, deadline=None)
@given(st.lists(st.tuples(st.sampled_from("kl"), st.sampled_from(["a", "b", "c", None])), max_size=8), st.lists(st.tuples(st.sampled_from("kl"), st.sampled_from("abc")), max_size=3))
def test_duplicates_follow_the_set_definition(spark, batch, existing):
    staged = spark.createDataFrame([(k, i, n) for n, (k, i) in enumerate(batch)], "natural_key_hash string, transaction_id string, batch_seq long")
    got = {r.batch_seq: r.is_duplicate for r in dedupe.flag_duplicates(staged, spark.createDataFrame(existing, "natural_key_hash string, transaction_id string")).collect()}
    for n, (k, i) in enumerate(batch):
        sets = [{j for kk, j in batch[:n] if kk == k and j}, {j for kk, j in existing if kk == k}]
        assert got[n] == (i is not None and any(s and i not in s for s in sets))


def test_marks():
    assert incremental.start_value(datetime(2024, 1, 2, tzinfo=timezone.utc), 3) == "2024-01-01T21:00:00Z" and incremental.start_value(None) is None


def test_files(spark, tmp_path):
    path = write_csv(tmp_path / "f.csv", record(merchant_name='"a ""q"", b"'), record(merchant_name="", country_code="NA"))
    rows = files.read_file(spark, path).collect()
    assert [r.merchant_name for r in rows] == ['a "q", b', None] and rows[1].country_code == "NA" and rows[0].batch_seq < rows[1].batch_seq
    (tmp_path / "f.txt").write_text("x")
    with pytest.raises(ValueError, match="Unsupported file type: .txt"):
        files.read_file(spark, str(tmp_path / "f.txt"))
    with pytest.raises(FileNotFoundError):
        files.read_file(spark, "nowhere.csv")


def write_broken(folder, end="\n"):
    """Three records whose quoted names hold line breaks, and those names."""
    said = [f"Two{end}lines", f'a ""q""{end}{end}, b', "one"]
    folder.mkdir()
    (folder / "t.csv").write_bytes((end.join([HEAD, *(",".join(record(transaction_id=f"TXN-{i}", merchant_name=f'"{x}"')) for i, x in enumerate(said))]) + end).encode())
    return [x.replace('""', '"').replace(end, "\n") for x in said]  # the reader makes each break \n


@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_line_breaks_in_quotes_stay_in_their_record(spark, tmp_path, end):
    want = write_broken(tmp_path / "in", end)
    rows = files.read_file(spark, str(tmp_path / "in" / "t.csv")).collect()
    assert [(r.transaction_id, r.merchant_name, r.country_code) for r in rows] == [(f"TXN-{i}", x, "GB") for i, x in enumerate(want)]


def test_new_files_with_line_breaks_in_quotes(spark, store, tmp_path):
    write_broken(tmp_path / "in")
    ingest_new_files(spark, store, ingest.Settings(), str(tmp_path / "in"), str(tmp_path / "check"))
    assert store.read("ingestion_run_log").first().input_records == 3


def test_rest_pages_retries_and_pushdown(spark):
    asked, failures = [], [503]

    class Stub(BaseHTTPRequestHandler):
        def do_GET(self):
            if failures:
                self.send_error(failures.pop())
                return
            q = parse_qs(urlparse(self.path).query)
            asked.append(q)
            rows = [dict(zip(schemas.FIELDS, record(transaction_id=f"TXN-{i}")), id=i, amount=1.5) for i in range(5)]
            at = int(q["offset"][0])
            body = json.dumps(rows[at : at + int(q["limit"][0])]).encode()
            self.send_response(200)
            self.end_headers()
            self.wfile.write(body)

        def log_message(self, *_):
            pass

    server = HTTPServer(("127.0.0.1", 0), Stub)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    url = f"http://127.0.0.1:{server.server_port}/t"
    rows = rest.read_rest(spark, url, "k", "2024-01-01T00:00:00Z", False, limit="2", backoff="0.01").collect()
    server.shutdown()
    assert [r.transaction_id for r in rows] == [f"TXN-{i}" for i in range(5)] and rows[0].amount == "1.5" and [r.batch_seq for r in rows] == [1, 2, 3, 4, 5]
    assert asked[0]["transaction_date"] == ["gt.2024-01-01T00:00:00Z"] and asked[-1]["offset"] == ["5"]
    with pytest.raises(ValueError, match="API key"):
        rest.read_rest(spark, url, None)


def test_new_files_are_ingested_once(spark, store, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    write_csv(folder / "a.csv", GOOD)
    run = lambda: ingest_new_files(spark, store, ingest.Settings(), str(folder), str(tmp_path / "check"))
    run()
    write_csv(folder / "b.csv", record(transaction_id="TXN-2", amount="3"))
    run()
    run()
    assert sorted(r.transaction_id for r in store.read("transactions").collect()) == ["TXN-1", "TXN-2"] and store.read("ingestion_run_log").count() == 2


def test_upsert_rewrites_touched_buckets_only(spark, store):
    rows = lambda ids, v: spark.createDataFrame([(i, v) for i in ids], "transaction_id string, v int")
    store.upsert("t", rows([f"{i}" for i in range(50)], 1), ["transaction_id"])
    before = store._manifest("t")["files"]
    store.upsert("t", rows(["3"], 2), ["transaction_id"])
    after = store._manifest("t")["files"]
    assert sum(before[b] != after[b] for b in before) == 1 and store.read("t").where("v = 2").count() == 1 and store.read("t").count() == 50


def test_command_line():
    args = cli.parser().parse_args(["incremental", "--lookback-days", "6"])
    assert args.lookback_hours == 6 and args.source_name == "transactions" and cli.parser().parse_args(["summary"]).output_table == "daily_account_summary"


def test_rows_of_a_folder_follow_its_files_by_path(spark, tmp_path):
    folder = tmp_path / "in put"
    folder.mkdir()
    write_csv(folder / "a.csv", record(transaction_id="TXN-A"))
    write_csv(folder / "b 1.csv", *(record(transaction_id=f"TXN-B{i}") for i in range(2000)))
    write_csv(folder / "c.csv", record(transaction_id="TXN-C0"), record(transaction_id="TXN-C1"))
    rows = files.read_file(spark, str(folder)).orderBy("batch_seq").select("transaction_id", "batch_seq").collect()
    assert [r.transaction_id for r in rows] == ["TXN-A", *(f"TXN-B{i}" for i in range(2000)), "TXN-C0", "TXN-C1"]
    assert len({r.batch_seq for r in rows}) == len(rows)


def test_records_of_other_lengths(spark, tmp_path):
    short = write_csv(tmp_path / "s.csv", GOOD, GOOD[:8])
    got = files.read_file(spark, short).orderBy("batch_seq").collect()
    assert [r.status for r in got] == ["completed", None] and got[1].merchant_category == "travel"
    quoted = write_csv(tmp_path / "q.csv", record(merchant_name='"a, ""b"", c"'), record(merchant_name='"x,y"')[:9])
    assert [r.merchant_name for r in files.read_file(spark, quoted).orderBy("batch_seq").collect()] == ['a, "b", c', "x,y"]
    long = write_csv(tmp_path / "l.csv", GOOD, [*GOOD, "surplus"])
    with pytest.raises(Exception, match="a record has more than 10 fields"):
        files.read_file(spark, long).collect()


def serve(pages):
    """A REST source of JSON records as they are."""

    class Stub(BaseHTTPRequestHandler):
        def do_GET(self):
            at = int(parse_qs(urlparse(self.path).query)["offset"][0])
            self.send_response(200)
            self.end_headers()
            self.wfile.write(json.dumps(pages[at : at + 100]).encode())

        def log_message(self, *_):
            pass

    server = HTTPServer(("127.0.0.1", 0), Stub)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    return server, f"http://127.0.0.1:{server.server_port}/t"


def test_rest_records_are_checked_as_received(spark, store):
    fine = dict(zip(schemas.FIELDS, GOOD)) | {"id": 1, "amount": 12.5}
    records = [fine, {k: v for k, v in fine.items() if k != "status"} | {"transaction_id": "TXN-2"}, fine | {"transaction_id": "TXN-3", "note": "x"}, fine | {"transaction_id": 4},
               fine | {"transaction_id": "TXN-5", "status": True}, fine | {"transaction_id": "TXN-6", "amount": "7.25", "currency": None}]
    server, url = serve(records)
    log = ingest.run_ingest(spark, store, ingest.Settings(source_type="rest", api_url=url, api_key="k"))
    server.shutdown()
    assert (log["valid_records"], log["quarantine_records"], log["status"]) == (1, 5, "success")
    got = {r.transaction_id: r.error_reason for r in store.read("quarantine").collect()}
    assert got["TXN-2"] == "record: 'status' is a required property"
    assert got["TXN-3"] == "record: Additional properties are not allowed ('note' was unexpected)"
    assert got["4"] == "transaction_id: 4 is not of type 'string'"
    assert got["TXN-5"] == "status: True is not of type 'string'; status: True is not one of ['completed', 'pending', 'failed', 'reversed']"
    assert got["TXN-6"].startswith("currency: None is not of type 'string'; currency: None is not one of")


def test_failed_runs_are_logged(spark, store, tmp_path):
    path = write_csv(tmp_path / "l.csv", GOOD, [*GOOD, "surplus"])
    with pytest.raises(Exception, match="more than 10 fields"):
        ingest.run_ingest(spark, store, ingest.Settings(source_file=path))
    row = store.read("ingestion_run_log").first()
    assert row.status == "failed" and row.input_records is None and store.read("transactions").count() == 0 and store.read("ingestion_watermark").count() == 0


def test_marks_advance_by_their_options(spark, tmp_path):
    path = write_csv(tmp_path / "t.csv", record(transaction_date="2024-01-05T10:00:00Z"), record(transaction_id="TXN-2", transaction_date="2024-02-05T10:00:00Z", status="lost"))
    older = write_csv(tmp_path / "o.csv", record(transaction_id="TXN-3", transaction_date="2024-01-02T10:00:00Z"))
    for options, days in (({}, ["02-05", "01-02"]), ({"advance_from": "valid"}, ["01-05", "01-02"]), ({"monotonic_mark": True}, ["02-05", "02-05"])):
        store = ParquetStore(spark, str(tmp_path / "-".join(["w", *days, *options])), buckets=2)
        for source, day in zip((path, older), days):
            ingest.run_ingest(spark, store, ingest.Settings(source_file=source, **options))
            assert incremental.latest_mark(store.read("ingestion_watermark"), "transactions").strftime("%m-%d") == day
    new, old = datetime(2024, 1, 2, tzinfo=timezone.utc), datetime(2024, 1, 3, tzinfo=timezone.utc)
    assert incremental.advances(None, new, True) and incremental.advances(old, new) and not incremental.advances(old, new, True) and not incremental.advances(old, None)


def test_summary_lands_in_its_own_dataset_and_can_follow_arrival(spark, tmp_path):
    s = ingest.Settings(source_file=write_csv(tmp_path / "t.csv", record(transaction_date="2024-01-05T10:00:00Z")), summary_by="ingestion_timestamp")
    store, gold = cli.stores(spark, s, str(tmp_path / "w"), None)
    ingest.run_ingest(spark, store, s)
    assert ingest.run_summary(spark, store, s, out=gold)["mode"] == "full refresh"
    assert gold.exists("daily_account_summary") and not store.exists("daily_account_summary") and (tmp_path / "w" / "gold").is_dir()
    late = ingest.Settings(source_file=write_csv(tmp_path / "late.csv", record(transaction_id="TXN-9", transaction_date="2024-01-01T10:00:00Z")))
    ingest.run_ingest(spark, store, late)
    assert ingest.run_summary(spark, store, s, out=gold)["rows_computed"] == 1
    assert sorted(str(r.transaction_date) for r in gold.read("daily_account_summary").collect()) == ["2024-01-01", "2024-01-05"]
    with pytest.raises(ValueError, match="needs a start value"):
        summary.changed_summary(store.read("transactions"), None)
    with pytest.raises(SystemExit):
        cli.main(["summary", "--sql-template", "x.sql"])


@settings(max_examples=4, deadline=None)
@given(st.lists(st.lists(st.integers(0, 30), min_size=1, max_size=12, unique=True), min_size=1, max_size=6))
def test_upserts_equal_a_dictionary(spark, tmp_path_factory, batches):
    import ledgerloom.store as module

    store, want = ParquetStore(spark, str(tmp_path_factory.mktemp("w")), buckets=2), {}
    most, module.MOST_CHANGES = module.MOST_CHANGES, 2
    try:
        for n, ids in enumerate(batches):
            store.upsert("t", spark.createDataFrame([(f"{i}", n) for i in ids] + [(None, n)], "k string, v int").coalesce(1), ["k"])
            want |= {f"{i}": n for i in ids}
        got = [(r.k, r.v) for r in store.read("t").collect()]
        assert {k: v for k, v in got if k is not None} == want and sorted(v for k, v in got if k is None) == list(range(len(batches))) and len(got) == len(want) + len(batches)
        assert all(len(of) <= 3 for of in store._manifest("t")["files"].values())
    finally:
        module.MOST_CHANGES = most


def test_buckets_double_as_a_table_grows_and_old_files_go(spark, tmp_path, monkeypatch):
    import ledgerloom.store as module

    store = ParquetStore(spark, str(tmp_path / "w"), buckets=1)
    rows = lambda a, b: spark.range(a, b).selectExpr("cast(id as string) k", "id v")
    store.upsert("t", rows(0, 50), ["k"])
    monkeypatch.setattr(module, "BUCKET_BYTES", 1000)
    store.upsert("t", rows(50, 100), ["k"])
    assert store._manifest("t")["buckets"] > 1 and store.read("t").count() == 100
    monkeypatch.setattr(module, "BUCKET_BYTES", 1 << 30)
    reader = store.read("t")
    store.upsert("t", rows(0, 1), ["k"])
    assert reader.count() == 100 and store.read("t").count() == 100
    live = {p for of in store._manifest("t")["files"].values() for p in of} | set(store._manifest("t")["retired"])
    assert {str(p) for p in (tmp_path / "w" / "t").glob("data-*/__b=*")} == live
    with pytest.raises(ValueError, match="rows are upserted"):
        store.append("t", rows(0, 1))


def test_summaries_are_partitioned_by_day(spark, store):
    rows = lambda *days: spark.createDataFrame([(f"a{i}", datetime(2024, 1, d).date(), v) for d, v in days for i in range(3)], "account_id string, transaction_date date, v int")
    layout = (["account_id", "transaction_date"], ["transaction_date"])
    store.replace("s", rows((1, 1), (2, 1), (3, 1)), *layout)
    before = store._manifest("s")["files"]
    assert sorted(before) == ["2024-01-01", "2024-01-02", "2024-01-03"]
    store.upsert("s", rows((2, 2), (4, 2)), *layout)
    after = store._manifest("s")["files"]
    assert [d for d in after if after[d] != before.get(d)] == ["2024-01-02", "2024-01-04"]
    day = store.read("s", ["2024-01-02"])
    assert {(r.account_id, r.v) for r in day.collect()} == {("a0", 2), ("a1", 2), ("a2", 2)} and all("2024-01-02" in f for f in day.inputFiles())
    assert store.read("s").count() == 12 and store.read("s", ["1999-01-01"]).count() == 0
    store.upsert("u", rows((1, 1)), ["account_id"], ["transaction_date"])
    with pytest.raises(ValueError, match="not partitioned"):
        store.read("u", ["2024-01-01"])
