"""Reading, building, checking and writing bars."""
