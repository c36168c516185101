from .bucketed import load_bucketed, save_bucketed
from .csv import csv_rejects, read_csv_typed, reject_counts
from .encoders import Encoding, fit_encoding, load_encoding, save_encoding
from .entityset import EntitySet, from_frames, load_csv, load_dictionary, load_parquet, save
from .featuredefs import load_defs, save_defs, write_matrix

__all__ = [n for n in dir() if not n.startswith("_")]
