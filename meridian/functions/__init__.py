"""Column helpers: time-series functions per code, cross-section functions per date."""
