"""Readers of files on disk."""

from spanwise.sources import changes, manifests, otlp


def test_manifest_files_below_a_root(spark, tmp_path):
    for path, text in (
        ("r1/package.json", '{"version":"1.2.3","dependencies":{"a":"^2.0.0"}}'),
        ("r1/package-lock.json", '{"packages":{"node_modules/a":{"version":"2.4.1"}}}'),
        ("r1/node_modules/x/package.json", '{"dependencies":{"ignored":"1.0.0"}}'),
        ("r2/sub/requirements.txt", "flask==3.0\n"),
    ):
        target = tmp_path / path
        target.parent.mkdir(parents=True, exist_ok=True)
        target.write_text(text)
    files = manifests.read_files(spark, str(tmp_path))
    assert {(r.repo, r.dir, r.basename) for r in files.collect()} == {
        ("r1", "r1", "package.json"), ("r1", "r1", "package-lock.json"), ("r2", "r2/sub", "requirements.txt"),
    }
    found = {(r.repo, r.name, r.version, r.provenance) for r in manifests.packages_from_manifests(files).collect()}
    assert found == {("r1", "a", "2.4.1", "OBSERVED"), ("r2", "flask", "3.0", "OBSERVED")}


def test_git_log_file_to_changes(spark, tmp_path):
    sha = "abcdef0123456789" * 2 + "abcdef01"
    record = "\x1e" + "\x1f".join([sha, "2024-05-01T10:00:00+02:00", "dev", "fix: a | b"]) + "\nsrc/a.py\nsrc/b.py\n"
    (tmp_path / "log.txt").write_text(record + record.replace("abcdef", "123456"))
    raw = changes.changes_from_git_log(changes.read_git_log(spark, str(tmp_path)), service="api")
    accepted, rejected = changes.load_changes(raw)
    row = accepted.filter(f"commit = '{sha}'").first()
    assert row.change_id == "CHG-GIT-" + sha[:12] and row.change_ms == 1714550400000
    assert row.files_changed == ["src/a.py", "src/b.py"] and accepted.count() == 2 and rejected.count() == 0


def test_torn_payloads_are_rejected_and_odd_values_are_not(spark):
    span = '{"traceId":"a","spanId":"b","name":"n","durationMs":%s}'
    whole = '{"resourceSpans":[{"scopeSpans":[{"spans":[' + span + "]}]}]}"
    texts = [whole % "5", (whole % "5")[:-4], "no json", None, whole % '"odd"', '{"resourceSpans":"odd"}', "{}", ""]
    rows = [(f"p{i}", i, 1, t) for i, t in enumerate(texts)]
    payloads = spark.createDataFrame(rows, "payload_id string, payload_seq long, received_ms long, payload string")
    good, rejects = otlp.spans_from_otlp_json(payloads)
    assert good.count() == 2
    assert {(r.payload_id, r.reason) for r in rejects.collect()} == {(f"p{i}", "unreadable payload") for i in (1, 2, 3, 5, 7)}
