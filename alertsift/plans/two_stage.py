"""The whole job: packet alerts, flow heads and the suppression policy, in one application.

Stage tables are Parquet under ``out``; each is read by several later steps, and a lost
executor costs no more than the stage at hand.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schema as S
from ..operators import cascade as C
from ..operators import classifiers as H
from ..operators import cleaning as L
from ..operators import detectors as D
from ..operators import features as X
from ..operators import flows as FL
from ..operators import mapping as MP
from ..operators import metrics as M
from ..operators import sampling, splits
from ..sources import captures as A


@dataclass
class Settings:
    """Sizes and model settings; defaults are those of the published protocol."""

    benign_packets: int = S.BENIGN_SAMPLE
    packets_per_attack: int = S.PACKETS_PER_ATTACK
    benign_flows: int = S.BENIGN_SAMPLE
    attack_flows: int | None = None
    hidden: Sequence[int] = (128, 64, 32)
    epochs: int = 20
    detector: str = "autoencoder"  # or "subspace", "isolation_forest"
    rank: int = 32
    head: dict = field(default_factory=lambda: {"rounds": 100, "depth": 6, "rate": 0.1})
    floor: float = S.RETENTION_FLOOR
    seed: int = S.SEED
    fit_on_train: bool = True


class TwoStageJob:
    def __init__(self, spark: SparkSession, packet_path: str, flow_path: str, out: str, settings: Settings | None = None):
        self.spark, self.packet_path, self.flow_path, self.out = spark, packet_path, flow_path, out
        self.s = settings or Settings()

    def _stage(self, name: str, build) -> DataFrame:
        """A stage table; changed settings or inputs get tables of their own."""
        mark = hashlib.md5(repr((self.s, self.packet_path, self.flow_path)).encode()).hexdigest()[:8]
        return A.stage_table(self.spark, os.path.join(self.out, f"{name}-{mark}"), build)

    # -- first stage: packets to alerts ---------------------------------------------------

    def packet_sample(self) -> DataFrame:
        def build():
            raw = A.scan_captures(self.spark, self.packet_path)
            fixed = {*S.PACKET_ID_COLUMNS, *S.ONE_HOT_COLUMNS, *S.CONSTANT_COLUMNS, "source_file", "label"}
            numeric = {c: F.col(f"`{c}`").try_cast("double") for c in raw.columns if c not in fixed}
            keyed = A.with_row_key(raw.withColumns(numeric))
            benign = keyed.where(F.col("label") == S.BENIGN)
            attacks = keyed.where(F.col("label") != S.BENIGN)
            seed = self.s.seed
            return sampling.sample_upto(benign, self.s.benign_packets, [], "packet_key", seed).unionByName(
                sampling.sample_upto(attacks, self.s.packets_per_attack, ["label"], "packet_key", seed)
            )

        return self._stage("packets", build)

    def prepared_packets(self) -> tuple[DataFrame, list[str]]:
        sample = self.packet_sample().drop("source_file")
        labelled = sample.withColumn("y_true", (F.col("label") != S.BENIGN).cast("int"))
        split = splits.stratified_split(
            labelled, ["y_true"], "packet_key", {"test": S.TEST_SHARE, "val": S.VAL_SHARE}, seed=self.s.seed
        ).drop("y_true")
        keep = ["packet_key", *S.PACKET_ID_COLUMNS, "split"]
        fit_on = F.col("id_split") == "train" if self.s.fit_on_train else None
        frame, names = L.prepare_packets(split, keep, fit_on=fit_on)
        return X.assemble(frame, names).select(*[F.col(f"id_{c}").alias(c) for c in keep], "label", "features"), names

    def cohort(self) -> DataFrame:
        def build():
            frame, names = self.prepared_packets()
            frame = self._stage("packet_features", lambda: frame)
            frame = frame.withColumn("y_true", (F.col("label") != S.BENIGN).cast("int"))
            train = frame.where("split = 'train'")
            scored = self._detector(train.where("y_true = 0"), len(names)).score(frame).drop("features")
            best = M.choose_threshold(scored.where("split = 'train'"), "anomaly_score", "y_true").first()
            return scored.withColumn("y2_alert", (F.col("anomaly_score") >= F.lit(best["threshold"])).cast("int"))

        return self._stage("cohort", build)

    def _detector(self, benign: DataFrame, width: int):
        s = self.s
        if s.detector == "subspace":
            return D.fit_subspace(benign, min(s.rank, width))
        if s.detector == "isolation_forest":
            return D.fit_isolation_forest(benign, "packet_key", seed=s.seed)
        return D.fit_autoencoder(benign, width, s.hidden, epochs=s.epochs, seed=s.seed, key="packet_key")

    # -- second stage: flows, mapping, heads ----------------------------------------------

    def rejected(self) -> DataFrame:
        """Segments without a Flow ID, which belong to no logical flow."""
        return self._stage("rejected_segments", lambda: A.read_flow_segments(self.spark, self.flow_path)[1])

    def unified(self) -> DataFrame:
        def build():
            segments, _ = A.read_flow_segments(self.spark, self.flow_path)
            return FL.build_unified_flows(segments, S.CAPTURE_RULES, tie="tie").withColumnRenamed("LogicalFlowID", "lfid")

        return self._stage("unified_flows", build)

    def flow_sample(self) -> DataFrame:
        def build():
            flows = self.unified()
            benign = sampling.sample_upto(flows.where(F.col("label") == S.BENIGN), self.s.benign_flows, [], "lfid", self.s.seed)
            attacks = sampling.sample_balanced(
                flows.where(F.col("label") != S.BENIGN), "lfid", total=self.s.attack_flows, seed=self.s.seed
            )
            shares = {"test": S.TEST_SHARE, "val": S.VAL_SHARE}
            return splits.stratified_split(benign.unionByName(attacks), ["label"], "lfid", shares, seed=self.s.seed)

        return self._stage("flow_sample", build)

    def candidates(self) -> DataFrame:
        return self._stage("candidates", lambda: MP.candidates(self.unified(), logical_id="lfid"))

    def aligned(self) -> DataFrame:
        def build():
            alerts = self.cohort().where("y2_alert = 1 AND split IN ('val', 'test')")
            return MP.classify_packets(alerts, MP.candidate_index(self.candidates()))

        return self._stage("alignment", build)

    def leakage(self) -> DataFrame:
        return MP.leakage_guard(self.flow_sample(), self.aligned(), self.candidates())

    def clean_sample(self) -> DataFrame:
        """The flow sample without flows that alerts reach, refilled per class and split."""

        def build():
            sample, aligned, cand, flows = self.flow_sample(), self.aligned(), self.candidates(), self.unified()
            kept, removed = MP.remove_leaks(sample, aligned, cand)
            used = sample.select("lfid").unionByName(MP.reachable_flows(aligned, cand))
            refill = sampling.resample_replacements(removed, flows, used, "lfid", seed=self.s.seed)
            return kept.unionByName(refill.select(*kept.columns))

        return self._stage("clean_sample", build)

    def scores(self) -> DataFrame:
        """All flows that alerts reach, scored by the four heads."""

        def build():
            sample = X.flow_features(self.clean_sample())
            wanted = MP.reachable_flows(self.aligned(), self.candidates())
            reach = X.flow_features(self.unified().join(wanted, "lfid", "left_semi"))
            base = ["lfid", "label", "source_file", "service_aligned", F.col("y_binary").alias("y_flow_attack")]
            out = reach.select(*base)
            for variant in ("behaviour", "service"):
                out = out.join(self._variant_scores(variant, sample, reach), "lfid")
            return out

        return self._stage("candidate_scores", build)

    def _variant_scores(self, variant: str, sample: DataFrame, reach: DataFrame) -> DataFrame:
        numeric, categorical = X.feature_lists(variant)
        pre = L.fit_preprocessor(sample.where("split = 'train'"), numeric, categorical)
        known = X.assemble(pre.apply(sample), pre.features).select("label", "y_binary", "split", "features").where("split <> 'test'")
        known = self._stage(f"matrix_{variant}", lambda: known).withColumn("stop", F.col("split") == "val")
        classes = [c for c in S.LABELS if c in {r[0] for r in known.select("label").distinct().collect()}]
        mc = H.fit_boosted(known, "label", classes, validation="stop", seed=self.s.seed, **self.s.head)
        binary = H.fit_boosted(known, "y_binary", [0, 1], validation="stop", seed=self.s.seed, **self.s.head)
        frame = X.assemble(pre.apply(reach), pre.features).select("lfid", "features")
        scored = mc.score(frame, f"pred_class_mc_{variant}").withColumn(f"s_mc_{variant}", H.attack_score(classes)).drop("probability")
        scored = binary.score(scored).withColumn(f"s_bin_{variant}", H.attack_score([0, 1]))
        return scored.select("lfid", f"s_mc_{variant}", f"s_bin_{variant}", f"pred_class_mc_{variant}")

    # -- suppression ----------------------------------------------------------------------

    HEADS = ("s_mc_behaviour", "s_bin_behaviour", "s_mc_service", "s_bin_service")

    def decisions(self) -> DataFrame:
        def build():
            keys = self.aligned().select(MP.KEY).where(F.col(MP.KEY).isNotNull()).distinct()
            reached = self.candidates().join(keys, MP.KEY, "left_semi")  # other keys are looked up by no alert
            per_key = C.key_scores(reached, self.scores(), self.HEADS)
            return C.alert_scores(self.aligned(), per_key, self.HEADS)

        return self._stage("decisions", build)

    def bake_off(self) -> DataFrame:
        return C.bake_off(C.select_threshold(self.decisions().where("split = 'val'"), floor=self.s.floor))

    def report(self) -> dict[str, DataFrame]:
        """Frozen configuration and its one evaluation on test alerts."""
        ranked = self._stage("bake_off", self.bake_off)
        winner = ranked.where("place = 1").first()
        if winner is None:
            raise ValueError("no validation alerts to choose a threshold on")
        test = C.apply_frozen(self.decisions().where("split = 'test'"), winner)
        missed = self.cohort().where("split = 'test' AND y2_alert = 0 AND y_true = 1").count()
        return {
            "bake_off": ranked,
            "rejected": self.rejected().groupBy("source_file").agg(F.count("*").alias("segments")),
            "leakage": self.leakage(),
            "leakage_after": MP.leakage_guard(self.clean_sample(), self.aligned(), self.candidates()),
            "unscored": MP.reachable_flows(self.aligned(), self.candidates())
            .join(self.scores(), "lfid", "left_anti")
            .agg(F.count("*").alias("flows")),
            "coverage": MP.status_coverage(self.aligned()),
            "test_metrics": C.cascade_metrics(test, missed),
            "class_retention": C.class_retention(test),
            "port_slices": C.port_slices(test),
            "mcnemar": C.mcnemar(test),
            "bootstrap": C.bootstrap_intervals(test, seed=self.s.seed),
            "usable_view": C.usable_view(test),
            "flow_summary": C.flow_summary(test),
            "violations": C.cascade_violations(test, winner, missed, self.s.floor),
        }
