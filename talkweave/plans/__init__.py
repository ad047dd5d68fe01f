"""Plan building blocks that stay parallel when one key holds a large share of the rows."""
