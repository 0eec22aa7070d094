from barloom.cli import main

raise SystemExit(main())
