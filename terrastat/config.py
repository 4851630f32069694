"""Fixed values of the fertility index and of the survey design.

All of them are parameters of the functions that use them; these are the
published defaults.
"""

INF = float("inf")

# Scoring thresholds, right-closed intervals (a, b].
SCORE_BINS = {
    "pH": [-INF, 5, 5.4, 5.8, 6, 7, 7.4, 7.8, 8.2, INF],
    "CEC": [-INF, 5, 16, 24, 40, INF],
    "K": [-INF, 0.1, 0.3, 0.5, 1, INF],
    "P": [-INF, 4, 7, 10, 15, INF],
    "C": [-INF, 1, 2, 3, 5, INF],
}
PH_LABELS = [1, 2, 3, 4, 5, 4, 3, 2, 1]

# Texture names, their codes and the score of each code.
TEXTURE_CODE = {
    "CLAY": "C",
    "CLAY LOAM": "CL",
    "LOAM": "L",
    "SAND": "S",
    "SANDY CLAY": "SC",
    "SANDY CLAY LOAM": "SCL",
    "SANDY LOAM": "SL",
    "LOAMY SAND": "LS",
    "SILTY CLAY": "SiC",
    "SILTY CLAY LOAM": "SiCL",
    "SILT": "Si",
    "SILT LOAM": "SiL",
}
TEXTURE_SCORE = {
    "S": 1,
    "Si": 1,
    "LS": 2,
    "SL": 3,
    "L": 3,
    "SiL": 3,
    "SiC": 4,
    "CL": 4,
    "SCL": 4,
    "SiCL": 5,
    "SC": 5,
    "C": 5,
}

# Classes of the index, right-closed.
CLASS_BREAKS = [-INF, 0.25, 0.50, 0.75, 0.90, INF]
CLASS_LABELS = ["Very low", "Low", "Moderate", "High", "Very high"]

# Thresholds of the tests and screens.
ALPHA = 0.05
STRONG_R = 0.75
VIF_LIMIT = 10.0
EXCLUDED_SHARE_WARNING = 0.10
GAP_SHARE_LIMIT = 0.001
EXPORT_NODATA = -9999.0
DEPTH_SD_RATIO_LIMIT = 2.0

# Survey design of the mixed models (first level = reference).
