"""Small static tables of the engine: classes, algorithms, providers, sensors, value ranges."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# fixed values
ALGORITHMS = [
    ("flood.baseline.threshold_sar", "flood.*", "baseline", ["sar"], 2048, False, 0.90, True),
    ("flood.baseline.ndwi_optical", "flood.*", "baseline", ["optical"], 2048, False, 0.85, True),
    ("flood.baseline.change_detection", "flood.*", "baseline", ["sar", "optical"], 4096, False, 0.88, True),
    ("flood.baseline.hand_model", "flood.riverine", "baseline", ["dem"], 3072, False, 0.80, True),
    ("flood.advanced.unet_segmentation", "flood.*", "advanced", ["sar"], 8192, True, 0.95, False),
    ("flood.advanced.ensemble_fusion", "flood.*", "advanced", ["sar", "optical", "dem"], 4096, False, 0.95, True),
    ("wildfire.baseline.nbr_differenced", "wildfire.*", "baseline", ["optical"], 4096, False, 0.96, True),
    ("wildfire.baseline.thermal_anomaly", "wildfire.*", "baseline", ["thermal"], 2048, False, 0.92, True),
    ("wildfire.baseline.ba_classifier", "wildfire.*", "baseline", ["optical"], 4096, False, 0.94, True),
    ("storm.baseline.wind_damage", "storm.*", "baseline", ["optical"], 4096, False, 0.88, True),
    ("storm.baseline.structural_damage", "storm.*", "baseline", ["optical"], None, False, 0.85, True),
]
VALUE_RANGES = {"ndwi": (-1.0, 1.0), "ndvi": (-1.0, 1.0), "reflectance": (0.0, 1.5), "sar_db": (-50.0, 20.0), "temperature_k": (150.0, 400.0), "elevation_m": (-500.0, 9000.0), "probability": (0.0, 1.0), "confidence": (0.0, 1.0)}


def algorithms(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(ALGORITHMS, "algorithm string, event_class string, category string, requires array<string>, memory_mb int, needs_gpu boolean, accuracy double, deterministic boolean")
