"""Fixed values that results depend on. Plain data, no logic."""

# Pipeline stages in log order.
SERVER_STAGES = ("read", "deser", "comp", "send")
CLIENT_STAGES = ("rcv", "decomp", "ser", "write")
STAGES = SERVER_STAGES + CLIENT_STAGES

# Codecs in search order ("first wins" on equal throughput).
CODECS = ("nocomp", "zstd", "lz4", "lzo", "snappy")

# Codec names of the moved data -> Spark writer codec. lzo has no Spark writer.
WRITER_CODECS = {
    "nocomp": "none",
    "zstd": "zstd",
    "snappy": "snappy",
    "lz4": "lz4",
    "zlib": "gzip",
}

# Largest codec number a block header may carry.
MAX_CODEC_NUMBER = 6

# Bytes per attribute type; CHAR and STRING carry their own size.
TYPE_BYTES = {"INT": 4, "DOUBLE": 8, "CHAR": 1}

# Worst-case text width (delimiter included); STRING(n) is n + 1.
TEXT_WIDTH = {"INT": 12, "LONG": 21, "DOUBLE": 24, "CHAR": 2}

# Effective rate = (SERIAL_SHARE + (1 - SERIAL_SHARE) * workers) * base rate.
SERIAL_SHARE = 0.3

# Worker cap = floor(cpus * WORKERS_PER_CPU).
WORKERS_PER_CPU = 1.2

# Network rate assumed when the environment says 0 (unlimited), MB/s.
UNLIMITED_NETWORK = 10000

# Storage ceilings in MB/s, (target, source, mode, read, write). Mode 1 is analytics, mode 2 storage.
CEILINGS = (
    ("postgres", "postgres", 2, 1000, 5000),
    ("spark", "postgres", 2, 1000, 7000),
    ("pandas", "csv", 2, 5000, 5000),
    ("csv", "csv", 1, 5000, 5000),
    ("csv", "csv", 2, 5000, 3000),
    ("csv", "postgres", 1, 1000, 5000),
    ("csv", "postgres", 2, 1000, 1400),
    ("pandas", "postgres", 1, 1000, 5000),
    ("pandas", "postgres", 2, 1000, 5000),
)
STORAGE_MODE = 2

# Table name -> short label, and the label order of reports.
TABLE_LABELS = {
    "lineitem_sf10": "lineitem",
    "ss13husallm": "acs",
    "iotm": "iot",
    "inputeventsm": "icu",
}
TABLE_ORDER = ("lineitem", "acs", "iot", "icu")

# Megabytes moved per named environment.
ENVIRONMENT_SIZES = {
    "iot_analysis": 3667,
    "backup": 10935,
    "icu_analysis": 3601,
    "copy": 10473,
    "etl": 10473,
    "pg": 10473,
}

# Optimizer labels in report order.
OPTIMIZER_ORDER = (
    "expert_copy",
    "expert_icu_anal.",
    "expert_backup",
    "expert_iot_anal.",
    "expert_etl",
    "expert_pg",
    "bf",
)

# Optimizer name -> its label in reports.
OPTIMIZER_LABELS = {"expert_icu_analysis": "expert_icu_anal.", "expert_iot_analysis": "expert_iot_anal."}

# Columns that describe one measured configuration.
CONFIG_COLUMNS = (
    "system",
    "table",
    "compression",
    "format",
    "network_parallelism",
    "bufpool_size",
    "buff_size",
    "network",
    "client_readmode",
    "client_cpu",
    "client_write_par",
    "client_decomp_par",
    "server_cpu",
    "server_read_par",
    "server_read_partitions",
    "server_deser_par",
    "server_comp_par",
)

# The same plus version and network quality, the key of averaged measurements.
AVERAGED_COLUMNS = (
    "engine_version",
    "system",
    "table",
    "compression",
    "format",
    "network_parallelism",
    "bufpool_size",
    "buff_size",
    "network",
    "network_latency",
    "network_loss",
    "client_readmode",
    "client_cpu",
    "client_write_par",
    "client_decomp_par",
    "server_cpu",
    "server_read_par",
    "server_read_partitions",
    "server_deser_par",
    "server_comp_par",
)

# Measured columns that say nothing about the configuration.
MEASURED_COLUMNS = ("date", "host", "time", "datasize", "avg_cpu_server", "avg_cpu_client")

# Operations of the control channel.
OPERATIONS = (
    "start_transfer",
    "acknowledged",
    "get_environment",
    "set_environment",
    "transfer_finished",
)
