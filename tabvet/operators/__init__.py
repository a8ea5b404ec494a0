"""DataFrame operators, one public function per survey row."""
