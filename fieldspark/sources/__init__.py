"""Sources and sinks: run tables, band files, transfer-function files, responses, stored spectra."""
