"""Sources and sinks: driver-table flow views, capture CSV scan, artifact bundle."""
