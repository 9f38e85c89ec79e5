"""Schemas, vocabularies and bands that are fixed."""

from pyspark.sql import types as T

INTERVALS = T.StructType([
    T.StructField("init_sec", T.LongType(), False),
    T.StructField("dur_sec", T.LongType(), False),
    T.StructField("stage", T.StringType()),
])
FEATURES = ["index_w", "index_r", "index_n", "index_1", "index_2", "index_3",
            "index_4", "noise", "theta", "delta"]

# Stage vocabularies, which must not be mixed.
RAT_STAGES = {"artefact": 0, "wake": 1, "nrem": 3, "ts": 4, "rem": 5}
PSG_STAGES = {0: "W", 1: "N1", 2: "N2", 3: "N3", 4: "REM", 5: "UNKNOWN"}
# Text to class for one PSG dataset; several texts share a class.
SLEEP_STAGE_TEXT = {
    "Sleep stage W": 0, "Sleep stage 1": 1, "Sleep stage 2": 2,
    "Sleep stage 3": 3, "Sleep stage 4": 3, "Sleep stage R": 4,
    "Sleep stage ?": 5, "Movement time": 5,
}
# Channel name to type; names not listed are intracranial.
CHANNEL_TYPES = {
    "EKG": "ecg", "EOG1": "eog", "EOG2": "eog", "EMG1": "emg", "EMG2": "emg",
    "EOG1-EOG2": "eog", "EMG1-EMG2": "emg",
    "TBAR": "eeg", "TBPR": "eeg", "TLR": "eeg", "TBAL": "eeg", "TBPL": "eeg",
    "TLL": "eeg", "TR": "eeg", "TL": "eeg", "T5": "eeg", "T6": "eeg",
    "C3": "eeg", "C4": "eeg", "Cz": "eeg", "Oz": "eeg",
}
# Feature bands in Hz with the channel each is measured on.
RAT_BANDS = {
    "noise": ("HPC", 0.0, 0.5), "delta": ("PFC", 0.5, 5.0), "theta": ("HPC", 6.0, 10.0),
    "sigma": ("PFC", 11.0, 17.0), "gamma": ("PFC", 35.0, 45.0),
}
CHANNEL_BANDS = {
    "delta": (0.5, 5.0), "theta": (6.0, 10.0), "sigma": (11.0, 17.0),
    "beta": (22.0, 30.0), "gamma": (35.0, 45.0), "total": (0.5, 45.0),
}
EEG_BANDS = {
    "delta": (0.5, 4.5), "theta": (4.5, 8.5), "alpha": (8.5, 11.5),
    "sigma": (11.5, 15.5), "beta": (15.5, 30.0),
}
