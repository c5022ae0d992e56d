"""Named cases, normalised outcomes, their comparison and reports."""
