"""The whole job on small capture files with the real column names."""

import csv
import os
import random

import pytest

from alertsift import schema as S
from alertsift.plans.two_stage import Settings, TwoStageJob
from alertsift.sources import captures as A

CAPTURES = ["BenignTraffic", "DDoS-HTTP_Flood-", "DoS-HTTP_Flood", "DNS_Spoofing", "XSS", "DictionaryBruteForce"]


@pytest.fixture(scope="module")
def capture_dirs(tmp_path_factory):
    root = tmp_path_factory.mktemp("captures")
    packets, flows = root / "packet_based", root / "flow_based"
    os.makedirs(packets), os.makedirs(flows)
    rng = random.Random(1)
    statistics = [f.name for f in A.flow_schema().fields]
    for c, capture in enumerate(CAPTURES):
        attack = int(c > 0)
        n = 400 if not attack else 60
        with open(packets / f"{capture}.csv", "w", newline="") as f:
            w = csv.writer(f)
            w.writerow([*S.PACKET_ID_COLUMNS, "packet_size", "jitter", "stream_60_count", "http_request_method"])
            for i in range(n):
                host = i % 40
                w.writerow(
                    [f"10.{c}.0.{host}", "10.9.0.1", 1000 + host, 443, 1, 0, rng.randint(40, 1500) + 900 * attack,
                     round(rng.random() + 2 * attack, 4), -1 if i % 9 == 0 else rng.randint(1, 50), "GET"]
                )
        with open(flows / f"{capture}.pcap_Flow.csv", "w", newline="") as f:
            w = csv.writer(f)
            w.writerow(statistics)
            for i in range(n):
                host = i % 80
                ids = {
                    "Flow ID": f"10.{c}.0.{host}-10.9.0.1-{1000 + host}-443-6", "Src IP": f"10.{c}.0.{host}",
                    "Src Port": 1000 + host, "Dst IP": "10.9.0.1", "Dst Port": 443, "Protocol": 6, "Label": "NeedManualLabel",
                    "Timestamp": f"{1 + i // 80:02d}/03/2022 {1 + i % 11:02d}:00:00 PM",
                }
                w.writerow([ids.get(name, rng.randint(0, 100) + 80 * attack) for name in statistics])
    return str(packets), str(flows)


def test_whole_job(spark, capture_dirs, tmp_path):
    settings = Settings(
        benign_packets=300, packets_per_attack=50, benign_flows=200, attack_flows=200, hidden=(6, 3), epochs=3,
        head={"rounds": 2, "depth": 2, "rate": 0.3},
    )
    job = TwoStageJob(spark, *capture_dirs, str(tmp_path), settings)

    cohort = job.cohort()
    assert {"packet_key", *S.PACKET_ID_COLUMNS, "label", "y_true", "split", "anomaly_score", "y2_alert"} <= set(cohort.columns)
    assert cohort.count() == 300 + 5 * 50
    assert cohort.where("anomaly_score IS NULL OR anomaly_score < 0").count() == 0
    assert {r.split for r in cohort.select("split").distinct().collect()} == {"train", "val", "test"}
    assert cohort.select("packet_key").distinct().count() == cohort.count()

    flows = job.unified()
    assert flows.select("lfid").distinct().count() == flows.count()
    assert set(S.behaviour_numeric()) - set(S.ENGINEERED) <= set(flows.columns)

    report = {k: [r.asDict() for r in df.collect()] for k, df in job.report().items()}
    assert all(r["violations"] == 0 for r in report["violations"])
    assert len(report["bake_off"]) == 8
    metrics = report["test_metrics"][0]
    assert metrics["kept_tp"] <= metrics["tp_alerts"] and metrics["kept_fp"] <= metrics["fp_alerts"]

    scores = job.scores()
    assert scores.where(" OR ".join(f"{h} IS NULL" for h in TwoStageJob.HEADS)).count() == 0
    # After the refill no train flow is reachable from an alert, and none is there twice.
    from alertsift.operators import mapping

    clean = job.clean_sample()
    guard = mapping.leakage_guard(clean, job.aligned(), job.candidates()).collect()
    assert all(r.overlap == 0 for r in guard)
    assert clean.select("lfid").distinct().count() == clean.count()
