"""Ready-made queries over the driver tables, with the SQL that checks each of them."""
