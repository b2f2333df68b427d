"""Flow-table vocabulary. Names and limits every flow file agrees on."""

# Columns of a flow file in file order.
FEATURES = [
    "duration", "protocol_type", "service", "flag", "src_bytes", "dst_bytes", "land", "wrong_fragment", "urgent", "hot",
    "num_failed_logins", "logged_in", "num_compromised", "root_shell", "su_attempted",
    "num_root", "num_file_creations", "num_shells", "num_access_files", "num_outbound_cmds",
    "is_host_login", "is_guest_login", "count", "srv_count", "serror_rate", "srv_serror_rate",
    "rerror_rate", "srv_rerror_rate", "same_srv_rate", "diff_srv_rate", "srv_diff_host_rate",
    "dst_host_count", "dst_host_srv_count", "dst_host_same_srv_rate", "dst_host_diff_srv_rate",
    "dst_host_same_src_port_rate", "dst_host_srv_diff_host_rate", "dst_host_serror_rate",
    "dst_host_srv_serror_rate", "dst_host_rerror_rate", "dst_host_srv_rerror_rate",
]

CATEGORICAL = ["protocol_type", "service", "flag"]

NUMERIC = [name for name in FEATURES if name not in CATEGORICAL]

CLASSES = ["normal", "dos", "probe", "r2l", "u2r"]

CLASS_MIX = {"normal": 0.53, "dos": 0.30, "probe": 0.11, "r2l": 0.05, "u2r": 0.01}

HARMLESS = ["normal", "benign"]

BYTE_CAP = 10_000_000

SUMMARY_FIELDS = ["duration", "protocol_type", "service", "flag", "src_bytes", "dst_bytes", "count"]

SEVERITIES = ["LOW", "MEDIUM", "HIGH", "CRITICAL"]

SEVERITY_THRESHOLDS = {"low": 0.5, "medium": 0.7, "high": 0.85, "critical": 0.95}

ESCALATED_CLASSES = ["u2r", "r2l"]
