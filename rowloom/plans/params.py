"""Parameters shared by the registered queries and their SQL."""

CUTOFFS = [
    ("1999-01-01", "train"),
    ("1999-07-01", "train"),
    ("2000-01-01", "train"),
    ("2000-07-01", "val"),
    ("2001-01-01", "test"),
]
LABEL_DAYS = 180

CONTEXT = {"width": 4, "seq_len": 32}
LEAK = {"width": 2, "seq_len": 16}
# Levels that the SQL writes out. Walks end earlier: a test sees that the last one has no entries.
UNROLLED = 10
SAMPLE_WIDTH = 3
SAMPLE_MOMENT = 962409600  # 2000-07-01
STRIPE = {"batch_size": 32, "world_size": 4, "epoch": 3, "seed": 7, "max_steps": 40}
AUC_STEPS = [1, 2, 3]
