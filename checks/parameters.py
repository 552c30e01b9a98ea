"""Settings shared by the registered queries and their SQL counterparts."""

K = 10
N_QUERIES = 5
QUERY_SEED = 7
SAMPLE_SEED = 0
SAMPLE_NUM = 300
NOISE_SEED = 11
# Time-block and value-block lengths for customer series and for vectors.
SPEND_T, SPEND_V = 8, 4
VECTOR_T, VECTOR_V = 32, 8
# Positions of the offset query run.
OFFSET_FIRST, OFFSET_LAST = 3, 14
KS = [1, 5, 10, 50]
DIMS = [5, 10, 16, 24, 27]
SAMPLE_NUMS = [50, 150, 600]
TIME_BLOCKS = [(4, 4), (8, 4), (16, 4), (27, 4)]
VALUE_BLOCKS = [(16, 1), (16, 2), (16, 4), (16, 16)]
JITTER_RATE = 0.1
AUGMENT_SIZE, AUGMENT_DIM = 2, 1
OBSERVED_ABOVE = 150.0
# Length of the series that a second write shortens, and what is added to ids that it adds.
SHORTER = 12
NEW_IDS = 1_000_000_000
