"""Column names and rule tables of packet and flow captures.

Fixed values: the lists and constants below are stated as the capture format, the label
convention and the published protocol define them; results depend on them.
"""

from __future__ import annotations

from dataclasses import dataclass, field

BENIGN = "benign"
UNKNOWN_ATTACK = "Unknown Attack"
BENIGN_PREFIX = "Benign"

# Ordered (substring of the capture name, label); first hit wins.
LABEL_RULES = [
    ("DDoS-HTTP", "DDOS-HTTP_flood"),
    ("DoS-HTTP", "DoS-HTTP"),
    ("Spoofing", "DNS_spoofing"),
    ("XSS", "XSS"),
    ("BruteForce", "brute_force"),
]
ATTACK_LABELS = [label for _, label in LABEL_RULES]
LABELS = [BENIGN, *ATTACK_LABELS]

# Seeds, sizes and cut-offs.
SEED = 23
GAP_SECONDS = 300
BENIGN_SAMPLE = 200_000
ATTACK_SAMPLE_MIN, ATTACK_SAMPLE_MAX = 4_000, 6_200
PACKETS_PER_ATTACK = 1_200
TEST_SHARE = VAL_SHARE = 0.15
TEMPORAL_FOLDS = 4
RETENTION_FLOOR = 0.95
MICROSECONDS = 1_000_000

# Names of identity columns contain one of these words.
IDENTIFIER_WORDS = [
    "ip", "port", "mac", "timestamp", "flow_id", "protocol",
    "server", "host", "user_agent", "oui", "uri", "content_type",
]
PACKET_ID_COLUMNS = ["src_ip", "dst_ip", "src_port", "dst_port", "l4_tcp", "l4_udp"]
ONE_HOT_COLUMNS = ["http_request_method", "handshake_version", "http_content_type"]
CONSTANT_COLUMNS = ["http_host"]

# Mapping statuses.
UNIQUE_MATCH = "unique_match"
SAME_LABEL = "multiple_same_label"
SAME_CAPTURE = "multiple_same_capture"
CONFLICTING = "multiple_conflicting_labels"
NO_MATCH = "no_match"
INVALID_KEY = "invalid_key"
STATUSES = [UNIQUE_MATCH, SAME_LABEL, SAME_CAPTURE, CONFLICTING, NO_MATCH, INVALID_KEY]

# Service ports.
HTTP_PORTS = [80, 8080, 443]
DNS_PORTS = [53]
KNOWN_SERVICES = {80: "http", 8080: "http", 443: "https", 53: "dns"}
SERVICE_PORTS = [80, 8080, 443, 53]

TIMESTAMP_FORMAT = "dd/MM/yyyy hh:mm:ss a"


@dataclass(frozen=True)
class FlowRules:
    """How the columns of the segments of one logical flow combine.

    ``weighted`` maps a mean to its weight, ``pooled`` a standard deviation to its
    (mean, count), ``squared`` a variance to the pooled deviation it is the square of, and
    ``rates`` a per-second rate to its numerator. ``derived`` holds SQL for the columns
    that weights and numerators refer to. ``identity`` and ``first`` columns keep their
    first non-null value: identity columns hardly vary within a Flow ID, so they serve as
    grouping keys of the first aggregation step; ``first`` columns vary and are numeric.
    """

    identity: list[str] = field(default_factory=list)
    first: list[str] = field(default_factory=list)
    sums: list[str] = field(default_factory=list)
    maxima: list[str] = field(default_factory=list)
    minima: list[str] = field(default_factory=list)
    weighted: dict[str, str] = field(default_factory=dict)
    pooled: dict[str, tuple[str, str]] = field(default_factory=dict)
    squared: dict[str, str] = field(default_factory=dict)
    rates: dict[str, str] = field(default_factory=dict)
    duration: str | None = None
    derived: dict[str, str] = field(default_factory=dict)


_FWD, _BWD, _ALL, _BYTES = "Total Fwd Packet", "Total Bwd packets", "total_packets", "total_bytes"

FLOW_METADATA = ["Flow ID", "Src IP", "Src Port", "Dst IP", "Dst Port", "Protocol", "Timestamp"]

# Aggregation rule of every flow statistic.
CAPTURE_RULES = FlowRules(
    identity=["label", "Src IP", "Src Port", "Dst IP", "Dst Port", "Protocol"],
    first=["FWD Init Win Bytes", "Bwd Init Win Bytes"],
    sums=[
        "Flow Duration", "Total Fwd Packet", "Total Bwd packets",
        "Total Length of Fwd Packet", "Total Length of Bwd Packet",
        "Fwd IAT Total", "Bwd IAT Total",
        "Fwd PSH Flags", "Bwd PSH Flags", "Fwd URG Flags", "Bwd URG Flags",
        "Fwd Header Length", "Bwd Header Length",
        "FIN Flag Count", "SYN Flag Count", "RST Flag Count", "PSH Flag Count",
        "ACK Flag Count", "URG Flag Count", "CWR Flag Count", "ECE Flag Count",
        "Subflow Fwd Packets", "Subflow Fwd Bytes", "Subflow Bwd Packets",
        "Subflow Bwd Bytes", "Fwd Act Data Pkts",
    ],
    maxima=[
        "Fwd Packet Length Max", "Bwd Packet Length Max", "Flow IAT Max", "Fwd IAT Max",
        "Bwd IAT Max", "Packet Length Max", "Active Max", "Idle Max",
    ],
    minima=[
        "Fwd Packet Length Min", "Bwd Packet Length Min", "Flow IAT Min", "Fwd IAT Min",
        "Bwd IAT Min", "Packet Length Min", "Fwd Seg Size Min", "Active Min", "Idle Min",
    ],
    weighted={
        "Fwd Packet Length Mean": _FWD, "Bwd Packet Length Mean": _BWD,
        "Fwd Segment Size Avg": _FWD, "Bwd Segment Size Avg": _BWD,
        "Fwd IAT Mean": _FWD, "Bwd IAT Mean": _BWD,
        "Packet Length Mean": _ALL, "Average Packet Size": _ALL, "Flow IAT Mean": _ALL,
        "Down/Up Ratio": _ALL, "Active Mean": _ALL, "Idle Mean": _ALL,
        "Fwd Bytes/Bulk Avg": _ALL, "Fwd Packet/Bulk Avg": _ALL, "Fwd Bulk Rate Avg": _ALL,
        "Bwd Bytes/Bulk Avg": _ALL, "Bwd Packet/Bulk Avg": _ALL, "Bwd Bulk Rate Avg": _ALL,
    },
    pooled={
        "Fwd Packet Length Std": ("Fwd Packet Length Mean", _FWD),
        "Bwd Packet Length Std": ("Bwd Packet Length Mean", _BWD),
        "Packet Length Std": ("Packet Length Mean", _ALL),
    },
    squared={"Packet Length Variance": "Packet Length Std"},
    rates={
        "Flow Bytes/s": _BYTES, "Flow Packets/s": _ALL,
        "Fwd Packets/s": _FWD, "Bwd Packets/s": _BWD,
    },
    duration="Flow Duration",
    derived={
        _ALL: "coalesce(`Total Fwd Packet`, 0) + coalesce(`Total Bwd packets`, 0)",
        _BYTES: "coalesce(`Total Length of Fwd Packet`, 0) + coalesce(`Total Length of Bwd Packet`, 0)",
    },
)
# Statistics whose pooled form is unknown, so unified flows leave them out.
DROPPED_STATISTICS = ["Flow IAT Std", "Fwd IAT Std", "Bwd IAT Std", "Active Std", "Idle Std"]

# Engineered and service columns of the feature matrices.
ENGINEERED = [
    "BytesPerPacket", "FwdBwdPacketRatio", "FwdBwdByteRatio", "BackwardFraction",
    "SynAckRatio", "LogDuration", "LogTotalPackets", "LogTotalBytes",
]
SERVICE_CATEGORICAL = ["Protocol", "KnownServiceCategory", "SourcePortRange", "DestinationPortRange"]
SERVICE_BINARY = ["IsHTTPService", "IsDNSService", "IsWellKnownDestinationPort"]

# Columns that may never enter a model matrix.
FORBIDDEN_FEATURES = [
    "Flow ID", "LogicalFlowID", "Src IP", "Dst IP", "Src Port", "Dst Port", "Timestamp",
    "ts_first", "ts_last", "source_file", "label", "Label", "service_aligned",
    "behaviorally_attack_like", "behavioral_bucket", "attempts_same_target_60s",
    "attempts_same_target_300s", "short_flow", "low_response", "syn_dominant",
    "repetition_extreme", "split", "temporal_fold",
]


def behaviour_numeric(rules: FlowRules = CAPTURE_RULES) -> list[str]:
    """Numeric columns of the behaviour-only matrix, in matrix order."""
    return [
        *rules.sums, *rules.maxima, *rules.minima, *rules.first, *rules.weighted, *rules.pooled,
        *rules.squared, *rules.rates, "SegmentCount", *ENGINEERED,
    ]
