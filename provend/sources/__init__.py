"""Sources: voucher CSV exports, closing stock, and document views over the test tables."""
