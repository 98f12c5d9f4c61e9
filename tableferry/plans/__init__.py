"""Transfer settings found by queries over the run logs."""
