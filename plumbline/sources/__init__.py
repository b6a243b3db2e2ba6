from plumbline.sources.config import ScanConfig, load_scan, save_scan
from plumbline.sources.sinks import write_flat, write_nested
from plumbline.sources.tables import Tables, path_source

__all__ = ["ScanConfig", "Tables", "load_scan", "path_source", "save_scan", "write_flat", "write_nested"]
