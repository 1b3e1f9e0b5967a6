"""Sources: testdata tables, derived fixtures, CSV/table scans, payloads."""
