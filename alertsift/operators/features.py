"""Flow features, service context and label-side diagnostics."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import schema as S
from ..functions.keys import is_attack, number
from ..session import materialise
from .cleaning import forbid_columns
from .ordering import number_rows
from .quantiles import exact_quantiles

EPS = 1e-9  # fixed value

# Which flow column plays which part; the default names are those of the capture format.
CAPTURE_COLUMNS = {
    "fwd_packets": "Total Fwd Packet", "bwd_packets": "Total Bwd packets",
    "fwd_bytes": "Total Length of Fwd Packet", "bwd_bytes": "Total Length of Bwd Packet",
    "syn": "SYN Flag Count", "ack": "ACK Flag Count", "duration": "Flow Duration",
    "src_port": "Src Port", "dst_port": "Dst Port", "protocol": "Protocol",
    "src_ip": "Src IP", "dst_ip": "Dst IP",
}


def _q(name: str) -> Column:
    return F.col(f"`{name}`")


def engineered_behaviour(df: DataFrame, cols: Mapping[str, str] = CAPTURE_COLUMNS) -> DataFrame:
    """Eight scale-free ratios and log sizes."""
    part = lambda role: F.coalesce(_q(cols[role]).cast("double"), F.lit(0.0))
    fp, bp, fb, bb = (part(r) for r in ("fwd_packets", "bwd_packets", "fwd_bytes", "bwd_bytes"))
    return df.withColumns(
        {
            "BytesPerPacket": (fb + bb) / (fp + bp + EPS),
            "FwdBwdPacketRatio": (fp + EPS) / (bp + EPS),
            "FwdBwdByteRatio": (fb + EPS) / (bb + EPS),
            "BackwardFraction": bp / (fp + bp + EPS),
            "SynAckRatio": (part("syn") + 1) / (part("ack") + 1),
            "LogDuration": F.log1p(F.greatest(part("duration"), F.lit(0.0))),
            "LogTotalPackets": F.log1p(fp + bp),
            "LogTotalBytes": F.log1p(fb + bb),
        }
    )


def port_range(port: Column) -> Column:
    p = number(port)
    return (
        F.when(p.isNull() | F.isnan(p) | (p <= 0), "none")
        .when(p <= 1023, "well_known")
        .when(p <= 49151, "registered")
        .otherwise("ephemeral")
    )


def _service(port: Column) -> Column:
    out = F.lit(None).cast("string")
    for p, name in S.KNOWN_SERVICES.items():
        out = F.when(number(port) == p, name).otherwise(out)
    return out


def _either(src: Column, dst: Column, ports: Sequence[int]) -> Column:
    return F.coalesce(number(src).isin(*ports), F.lit(False)) | F.coalesce(number(dst).isin(*ports), F.lit(False))


def service_fields(df: DataFrame, cols: Mapping[str, str] = CAPTURE_COLUMNS) -> DataFrame:
    """Port semantics only: service, ranges, flags and the protocol as text."""
    src, dst = _q(cols["src_port"]), _q(cols["dst_port"])
    return df.withColumns(
        {
            "KnownServiceCategory": F.coalesce(_service(dst), _service(src), F.lit("other")),
            "SourcePortRange": port_range(src),
            "DestinationPortRange": port_range(dst),
            "IsHTTPService": _either(src, dst, S.HTTP_PORTS).cast("int"),
            "IsDNSService": _either(src, dst, S.DNS_PORTS).cast("int"),
            "IsWellKnownDestinationPort": F.coalesce((number(dst) > 0) & (number(dst) <= 1023), F.lit(False)).cast("int"),
            "Protocol": F.coalesce(number(_q(cols["protocol"])), F.lit(0.0)).cast("int").cast("string"),
        }
    )


def service_aligned(cols: Mapping[str, str] = CAPTURE_COLUMNS, label: str = "label") -> Column:
    """Does the port and protocol of a flow fit its attack class? A diagnostic, never a feature."""
    src, dst, protocol, lab = _q(cols["src_port"]), _q(cols["dst_port"]), number(_q(cols["protocol"])), _q(label)
    tcp, udp = protocol == 6, protocol == 17
    return (
        F.when((lab == "DNS_spoofing") & (tcp | udp) & _either(src, dst, [53]), "aligned")
        .when((lab == "XSS") & tcp & _either(src, dst, [80, 443]), "aligned")
        .when(lab.isin("DoS-HTTP", "DDOS-HTTP_flood") & tcp & _either(src, dst, [80, 8080]), "aligned")
        .when(lab == "brute_force", "service_indeterminate")
        .when(lab == S.BENIGN, "benign")
        .otherwise("unaligned")
    )


def _count_back(own: Sequence[str], windows: Sequence[int], span: int):
    """Adds up the rows before each second in its windows; input in order of pair, chunk and time.

    ``_at`` is the time from the start of the chunk's history. Of the last chunk of a batch only the entries within
    the longest window are carried on.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, carried_at, carried_n = None, np.empty(0), np.empty(0, np.int64)
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = [batch.column(c) for c in (*own, "_chunk")]
            starts = np.zeros(batch.num_rows, bool)
            for key in keys:
                starts[1:] |= pc.not_equal(key[1:], key[:-1]).to_numpy(zero_copy_only=False)
            at, n = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("_at", "_n"))
            held = len(carried_at) if [k[0] for k in keys] == last else 0
            group = np.concatenate([np.zeros(held, np.int64), np.cumsum(starts)])
            at, n = np.concatenate([carried_at[:held].astype(at.dtype), at]), np.concatenate([carried_n[:held], n])
            place = group * span + at  # grows over the batch, and no window reaches into another chunk
            total = np.concatenate([[0], np.cumsum(n)])
            before = [total[held:-1] - total[np.searchsorted(place, place[held:] - w)] for w in windows]
            out = [*(batch.column(c) for c in (*own, "_ts", "_n")), *map(pa.array, before)]
            names = [*own, "_ts", "_n", *(f"_before{k}" for k in range(len(windows)))]
            yield pa.RecordBatch.from_arrays(out, names).filter(batch.column("_home"))
            last = [k[-1] for k in keys]
            near = (group == group[-1]) & (at >= at[-1] - max(windows))
            carried_at, carried_n = at[near], n[near]

    return count


def attempts_same_target(
    df: DataFrame,
    windows: Mapping[str, int],
    pair: Sequence[str],
    ts: str,
    tie: str,
    chunk: int = 86_400,
) -> DataFrame:
    """Rows of the same pair in the closed look-back window, counting earlier rows and itself.

    Every row stays; where the time or a part of the pair is null the count is null.

    ``windows`` maps output names to seconds; ``ts`` is in whole seconds. Rows of equal time
    count in the order of ``tie``. Counting works on (pair, second) totals cut into chunks
    (of a day, or the longest window) with one window of history, so a pair with a third of all rows has at most
    that many entries per task. A count is the difference of two running totals, at the row and at the
    start of its window, so the work does not grow with the entries in a window.
    """
    pair = list(pair)
    longest = max(windows.values())
    chunk = max(chunk, longest)
    known = df.dropna("any", subset=[*pair, ts])
    seconds = known.groupBy(*[_q(p) for p in pair], _q(ts)).agg(F.count("*").alias("_n"))
    home = F.floor(_q(ts) / chunk)
    late = _q(ts) - home * chunk >= chunk - longest
    copies = F.array_compact(F.array(F.struct(home.alias("_chunk"), F.lit(True).alias("_home")),
                                     F.when(late, F.struct((home + 1).alias("_chunk"), F.lit(False).alias("_home")))))
    own = [f"_own{i}" for i in range(len(pair))]
    placed = seconds.select(
        *[_q(p).alias(o) for p, o in zip(pair, own, strict=True)], _q(ts).alias("_ts"), "_n", F.inline(copies)
    ).withColumn("_at", F.col("_ts") - F.col("_chunk") * chunk + longest)
    names = [f"_before_{name}" for name in windows]
    kept = placed.schema[: len(own) + 2]
    schema = ", ".join([f"{f.name} {f.dataType.simpleString()}" for f in kept] + [f"{n} long" for n in names])
    dealt = placed.repartition(*own, "_chunk").sortWithinPartitions(*own, "_chunk", "_ts")
    counted = dealt.mapInArrow(_count_back(own, list(windows.values()), chunk + 2 * longest + 1), schema)
    history = counted.toDF(*pair, ts, "_n", *names)
    joined = materialise(df.join(history, [*pair, ts], "left"))  # read once for crowded seconds, once for the others
    crowded, alone = joined.where("_n > 1"), joined.where("_n = 1 OR _n IS NULL").withColumn("_rank", F.lit(1).cast("long"))
    ranked = alone if crowded.isEmpty() else number_rows(crowded, [*pair, ts], [tie], "_rank").unionByName(alone)
    return ranked.withColumns({name: F.col(f"_before_{name}") + F.col("_rank") for name in windows}).drop(
        "_n", "_rank", *names
    )


@dataclass(frozen=True)
class RepetitionThresholds:
    short_duration: float
    low_backward_fraction: float
    high_syn_ack: float
    extreme_attempts: float


def fit_repetition_thresholds(benign_train: DataFrame, duration: str, attempts: str = "attempts_same_target_60s") -> RepetitionThresholds:
    """Quantiles of benign training flows: p25, p10, p90 and p99."""
    wanted = [(duration, 0.25), ("BackwardFraction", 0.10), ("SynAckRatio", 0.90), (attempts, 0.99)]
    q = exact_quantiles(benign_train, [c for c, _ in wanted], sorted({p for _, p in wanted}))
    place = {p: i for i, p in enumerate(sorted({p for _, p in wanted}))}
    return RepetitionThresholds(*[q[c][place[p]] for c, p in wanted])


def repetition_flags(df: DataFrame, t: RepetitionThresholds, duration: str, attempts: str = "attempts_same_target_60s") -> DataFrame:
    """Four threshold flags, the combined flag and its bucket label."""
    hit = lambda cond: F.coalesce(cond, F.lit(False)).cast("int")
    flagged = df.withColumns(
        {
            "short_flow": hit(_q(duration) <= t.short_duration),
            "low_response": hit(F.col("BackwardFraction") <= t.low_backward_fraction),
            "syn_dominant": hit(F.col("SynAckRatio") >= t.high_syn_ack),
            "repetition_extreme": hit(_q(attempts) >= t.extreme_attempts),
        }
    )
    votes = F.col("short_flow") + F.col("low_response") + F.col("syn_dominant")
    alike = ((F.col("repetition_extreme") == 1) & (votes >= 2)).cast("int")
    return flagged.withColumns(
        {
            "behaviorally_attack_like": alike,
            "behavioral_bucket": F.when(alike == 1, "behaviorally_attack_like").otherwise("behaviorally_ambiguous"),
        }
    )


FLAGS = ["short_flow", "low_response", "syn_dominant", "repetition_extreme", "behaviorally_attack_like"]


def flag_prevalence(df: DataFrame, by: Sequence[str], flags: Sequence[str] = tuple(FLAGS)) -> DataFrame:
    return df.groupBy(*by).agg(F.count("*").alias("n"), *[F.avg(F.col(f).cast("double")).alias(f) for f in flags])


def feature_lists(variant: str, numeric: Sequence[str] | None = None) -> tuple[list[str], list[str]]:
    """(numeric, categorical) columns of the behaviour-only or service-aware matrix."""
    numeric = list(numeric or S.behaviour_numeric())
    if variant == "behaviour":
        lists = numeric, []
    elif variant == "service":
        lists = [*numeric, *S.SERVICE_BINARY], list(S.SERVICE_CATEGORICAL)
    else:
        raise ValueError(f"unknown variant {variant}")
    forbid_columns([*lists[0], *lists[1]])
    return lists


def assemble(df: DataFrame, features: Sequence[str], out: str = "features") -> DataFrame:
    """One vector column; refuses identity, label and diagnostic columns."""
    forbid_columns(features)
    # The assembler reads dots in names as field access, so it gets plain aliases.
    aliases = {f"_f{i}": _q(c).cast("double") for i, c in enumerate(features)}
    return VectorAssembler(inputCols=list(aliases), outputCol=out).transform(df.withColumns(aliases)).drop(*aliases)


def flow_features(df: DataFrame, cols: Mapping[str, str] = CAPTURE_COLUMNS) -> DataFrame:
    """Engineered and service columns, both targets and the alignment diagnostic."""
    diagnosed = df.withColumns({"service_aligned": service_aligned(cols), "y_binary": is_attack(F.col("label"))})
    return service_fields(engineered_behaviour(diagnosed, cols), cols)
