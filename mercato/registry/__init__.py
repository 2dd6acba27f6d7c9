"""Every operator as a query over the supplied tables, with its SQL twin."""
