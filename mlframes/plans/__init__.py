"""Building blocks that keep jobs whole and balanced when one key holds much of the data."""
